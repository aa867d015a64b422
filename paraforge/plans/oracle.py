"""DuckDB SQL builders for the correctness oracle.

These restate the operators in plain SQL over the supplied tables (views ``documents``,
``conversations``, ``labels``, ...). DuckDB's RE2 has no lookarounds and ASCII ``\\s``/``\\w``/``\\b``,
so whitespace and word classes are spelled out with Unicode ranges, and the sentence break is
marked with a control character and split on it.
"""

from __future__ import annotations

from paraforge.functions.text import ABBREVIATIONS, PERIOD_PLACEHOLDER

# Unicode White_Space, the class Java's (?U)\s uses.
WS = r"[\t-\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NONWORD = r"[^\pL\pN_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q(WS + '+')}), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_distinct({words(f'lower({x})')})"


def overlap_tok(ta: str, tb: str) -> str:
    inter = f"len(list_intersect({ta}, {tb}))"
    return (f"(CASE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0 "
            f"ELSE {inter}::DOUBLE / (len({ta}) + len({tb}) - {inter}) END)")


def overlap(a: str, b: str) -> str:
    return overlap_tok(tokens(a), tokens(b))


def split_sentences(x: str) -> str:
    alt = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    protected = f"regexp_replace({x}, {q('(^|' + NONWORD + ')(' + alt + r')\.')}, {q(chr(92) + '1' + chr(92) + '2' + PERIOD_PLACEHOLDER)}, 'g')"
    marked = (f"regexp_replace({trim_ws(protected)}, {q('([.!?])' + WS + '+([A-Z])')}, "
              f"'\\1' || chr(1) || '\\2', 'g')")
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), "
            f"lambda s: {trim_ws(f'replace(s, {q(PERIOD_PLACEHOLDER)}, {q(chr(46))})')}), lambda s: s <> '')")


def proper_nouns(x: str) -> str:
    cleaned = f"list_transform(list_filter({words(x)}, lambda w, i: i > 1), lambda w: regexp_replace(w, {q(NONWORD)}, '', 'g'))"
    return f"list_distinct(list_transform(list_filter({cleaned}, lambda w: regexp_matches(w, '^\\p{{Lu}}')), lambda w: lower(w)))"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({x}, ''), '(\\p{{Nd}}+)', 1))"


def new_entities(orig: str, cand: str) -> str:
    return (f"(len(list_filter({proper_nouns(cand)}, lambda e: NOT list_contains({proper_nouns(orig)}, e))) > 0 "
            f"OR len(list_filter({numbers(cand)}, lambda e: NOT list_contains({numbers(orig)}, e))) > 0)")


def md5_key(*cols: str, seed="42") -> str:
    parts = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5({parts} || ':' || {q(str(seed))})"


def list_literal(arr: str) -> str:
    esc = ("replace(replace(replace(replace(replace(s, '\\', '\\\\'), '\"', '\\\"'), "
           "chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')")
    return f"'[' || array_to_string(list_transform({arr}, lambda s: '\"' || {esc} || '\"'), ', ') || ']'"


# ---- fixture CTEs ---------------------------------------------------------------------------

def cte_sentences() -> str:
    return f"""sentences AS (
  SELECT d.doc_id, (u.i - 1)::INTEGER AS pos, d.arr[u.i] AS sentence
  FROM (SELECT doc_id, {split_sentences('text')} AS arr FROM documents) d,
       range(1, len(d.arr) + 1) u(i))"""


def cte_conv_sentences() -> str:
    return f"""conv_split AS (
  SELECT c.conv_id, c.turn, c.role, u.i AS spos, c.arr[u.i] AS sentence
  FROM (SELECT conv_id, turn, role, {split_sentences('text')} AS arr FROM conversations) c,
       range(1, len(c.arr) + 1) u(i)),
conv_sentences AS (
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, spos) - 1)::BIGINT AS pos,
         turn, role, sentence FROM conv_split)"""


def cte_clusters(source: str = "conversations") -> str:
    if source == "conversations":
        return cte_conv_sentences() + """,
clusters AS (SELECT conv_id AS cluster_id, pos, sentence FROM conv_sentences)"""
    return cte_sentences() + """,
clusters AS (SELECT doc_id AS cluster_id, pos::BIGINT AS pos, sentence FROM sentences)"""


def cte_band_pairs(lo: float, hi: float, source: str = "conversations") -> str:
    return cte_clusters(source) + f""",
tok AS (SELECT cluster_id, pos, sentence, {tokens('sentence')} AS t FROM clusters),
scored AS (
  SELECT a.cluster_id, a.pos AS pos1, b.pos AS pos2, a.sentence AS sentence1, b.sentence AS sentence2,
         {overlap_tok('a.t', 'b.t')} AS overlap
  FROM tok a JOIN tok b ON a.cluster_id = b.cluster_id AND a.pos < b.pos),
band AS (SELECT * FROM scored WHERE overlap BETWEEN {lo} AND {hi})"""


def cte_labelled_pairs() -> str:
    return cte_sentences() + """,
lab AS (SELECT s.doc_id, s.pos, s.sentence, l.quality AS label FROM sentences s JOIN labels l USING (doc_id)),
labelled_pairs AS (
  SELECT (row_number() OVER (ORDER BY a.doc_id, a.pos, b.pos) - 1)::BIGINT AS ord, a.doc_id,
         a.sentence AS question1, b.sentence AS question2, a.label
  FROM lab a JOIN lab b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 8)"""


def cte_paraphrase_lists() -> str:
    return cte_conv_sentences() + f""",
nxt AS (
  SELECT a.conv_id, a.pos, list(b.sentence ORDER BY b.pos) AS f
  FROM conv_sentences a JOIN conv_sentences b ON a.conv_id = b.conv_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5
  GROUP BY a.conv_id, a.pos),
paraphrase_lists AS (
  SELECT (row_number() OVER (ORDER BY c.conv_id, c.pos) - 1)::BIGINT AS ord, c.sentence AS text,
         {list_literal('n.f')} AS paraphrases,
         CASE WHEN c.role = 'assistant' THEN 'sentence' ELSE 'question' END AS category,
         c.role AS source
  FROM conv_sentences c JOIN nxt n USING (conv_id, pos))"""


def cte_candidates(source: str = "conversations") -> str:
    if source == "conversations":
        head = cte_conv_sentences() + ",\nitems AS (SELECT conv_id AS tid, pos, sentence FROM conv_sentences)"
        prefix = "c"
    else:
        head = cte_sentences() + ",\nitems AS (SELECT doc_id AS tid, pos::BIGINT AS pos, sentence FROM sentences)"
        prefix = "d"
    return head + f""",
candidates AS (
  SELECT '{prefix}' || CAST(a.tid AS VARCHAR) || ':' || CAST(a.pos AS VARCHAR) AS sentence_id,
         a.sentence AS original, (b.pos - a.pos - 1)::INTEGER AS gen_idx, b.sentence AS text
  FROM items a JOIN items b ON a.tid = b.tid AND b.pos BETWEEN a.pos + 1 AND a.pos + 8)"""


def cte_sentence_pairs() -> str:
    return cte_labelled_pairs() + """,
lp_n AS (SELECT count(*) AS n FROM labelled_pairs),
sentence_pairs AS (
  SELECT ord, question1 AS sentence1, question2 AS sentence2, label,
         CASE WHEN ord < floor(n * 0.8) THEN 'train'
              WHEN ord < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split
  FROM labelled_pairs, lp_n)"""


def parse_list(x: str) -> str:
    fixed = f"regexp_replace({x}, '\\\\x([0-9a-fA-F]{{2}})', '\\\\u00\\1', 'g')"
    return f"from_json({fixed}, '[\"VARCHAR\"]')"


def cte_sources(lo: float, hi: float) -> str:
    """Question pairs (labelled, positive) and declarative pairs (first paraphrase), in band."""
    return cte_labelled_pairs() + ",\n" + cte_paraphrase_lists() + f""",
qpairs AS (SELECT ord, question1 AS sentence1, question2 AS sentence2, {overlap('question1', 'question2')} AS overlap
           FROM labelled_pairs WHERE label = 1),
qsrc AS (SELECT 0 AS source_rank, * FROM qpairs WHERE overlap BETWEEN {lo} AND {hi}),
dpairs AS (SELECT ord, text AS sentence1, {parse_list('paraphrases')}[1] AS sentence2 FROM paraphrase_lists
           WHERE category = 'sentence'),
dsrc AS (SELECT 1 AS source_rank, ord, sentence1, sentence2, {overlap('sentence1', 'sentence2')} AS overlap FROM dpairs
         WHERE {overlap('sentence1', 'sentence2')} BETWEEN {lo} AND {hi}),
both_src AS (SELECT * FROM qsrc UNION ALL SELECT * FROM dsrc)"""


def cte_scored(source: str = "conversations") -> str:
    """candidates + overlap + term-frequency cosine similarity."""
    return cte_candidates(source) + ",\n" + scoring_ctes()


def scoring_ctes() -> str:
    """Scores for a ``candidates`` CTE (sentence_id, original, gen_idx, text)."""
    return f"""cpairs AS (SELECT DISTINCT original, text FROM candidates),
texts AS (SELECT original AS t FROM cpairs UNION SELECT text FROM cpairs),
tf AS (SELECT t, tok, count(*) AS c FROM (SELECT t, unnest({words('lower(t)')}) AS tok FROM texts) GROUP BY t, tok),
nrm AS (SELECT t, sqrt(sum(c * c)) AS nrm FROM tf GROUP BY t),
dots AS (SELECT p.original, p.text, sum(a.c * b.c) AS dot FROM cpairs p JOIN tf a ON a.t = p.original
         JOIN tf b ON b.t = p.text AND b.tok = a.tok GROUP BY p.original, p.text),
sims AS (SELECT p.original, p.text,
           CASE WHEN na.nrm IS NULL OR nb.nrm IS NULL OR na.nrm = 0 OR nb.nrm = 0 THEN 0.0
                ELSE coalesce(d.dot, 0)::DOUBLE / (na.nrm * nb.nrm) END AS similarity
         FROM cpairs p LEFT JOIN dots d ON d.original = p.original AND d.text = p.text
         LEFT JOIN nrm na ON na.t = p.original LEFT JOIN nrm nb ON nb.t = p.text),
scored AS (SELECT c.sentence_id, c.original, c.gen_idx, c.text, {overlap('c.original', 'c.text')} AS overlap, s.similarity
           FROM candidates c JOIN sims s ON s.original = c.original AND s.text = c.text)"""


def all_sentences(source: str) -> str:
    """Every sentence of a source; ``scored``: those that have candidates (the caller joins the rest)."""
    if source == "scored":
        return "SELECT DISTINCT sentence_id, original FROM scored"
    table, tid, prefix = ("conv_sentences", "conv_id", "c") if source == "conversations" else ("sentences", "doc_id", "d")
    return (f"SELECT '{prefix}' || CAST({tid} AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS sentence_id, "
            f"sentence AS original FROM {table}")


def select_sql(cond: str, fallback: bool, source: str = "conversations") -> str:
    """Selection over ``scored``: lowest (overlap, gen_idx) among passing candidates, for every
    sentence; one without candidates keeps its text and is not confident."""
    fb_join = "LEFT JOIN lowest l USING (sentence_id)" if fallback else ""
    fb = "l." if fallback else "b."
    return f"""passing AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY overlap, gen_idx) AS rn
            FROM scored WHERE {cond}),
best AS (SELECT * FROM passing WHERE rn = 1),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY overlap, gen_idx) AS rn FROM scored) WHERE rn = 1),
sents AS ({all_sentences(source)}),
selected AS (
  SELECT s.sentence_id, s.original,
         coalesce(b.text, {fb}text, s.original) AS paraphrased,
         (b.sentence_id IS NOT NULL {'OR l.sentence_id IS NOT NULL' if fallback else ''}) AS confident,
         coalesce(b.gen_idx, {fb}gen_idx, -1)::INTEGER AS gen_idx,
         round(coalesce(b.overlap, {fb}overlap), 6) AS overlap
  FROM sents s LEFT JOIN best b USING (sentence_id) {fb_join})"""


def clean_words(x: str) -> str:
    return f"list_filter(list_transform({words(x)}, lambda w: regexp_replace(lower(w), '[^\\pL]', '', 'g')), lambda w: w <> '')"


def cte_lexicon() -> str:
    from paraforge.operators.lexicon import DETACH_DEPTH, DETACHMENTS
    from paraforge.sources.fixtures import EXTRA_LEMMAS, IRREGULAR
    endings = ", ".join(f"({q(p)}, {q(o)}, {q(n)})" for p, rules in DETACHMENTS.items() for o, n in rules)
    irregular = ", ".join(f"({q(p)}, {q(f)}, {q(b)})" for p, f, b in IRREGULAR)
    parts = ", ".join(f"({q(p)})" for p in DETACHMENTS)
    extra = ", ".join(f"({q(a)}, {q(b)}, {c})" for a, b, c in EXTRA_LEMMAS)
    return cte_conv_sentences() + f""",
cw AS (SELECT c.conv_id, c.pos, u.i - 1 AS i, c.ws[u.i] AS w
       FROM (SELECT conv_id, pos, {clean_words('sentence')} AS ws FROM conv_sentences) c, range(1, len(c.ws) + 1) u(i)),
lexwords AS (SELECT DISTINCT w AS word FROM cw WHERE length(w) >= 3),
word_synsets AS (SELECT word, 'n' AS pos, 'p:' || substr(word, 1, 5) AS synset_id FROM lexwords
                 UNION ALL SELECT word, 'v', 's:' || right(word, 5) FROM lexwords),
freq AS (SELECT w AS word, count(*) AS lemma_count FROM cw WHERE length(w) >= 3 GROUP BY w),
lem0 AS (SELECT ws.synset_id, ws.word AS lemma, f.lemma_count FROM word_synsets ws JOIN freq f USING (word)
         UNION ALL SELECT * FROM (VALUES {extra}) v(synset_id, lemma, lemma_count)),
synset_lemmas AS (SELECT synset_id, lemma, lemma_count, row_number() OVER (ORDER BY synset_id, lemma) - 1 AS ord FROM lem0),
bg AS (SELECT a.w AS prev, b.w AS token, count(*) AS n FROM cw a JOIN cw b ON a.conv_id = b.conv_id AND a.pos = b.pos AND b.i = a.i + 1
       GROUP BY a.w, b.w),
bigram AS (SELECT prev, token, n::DOUBLE / sum(n) OVER (PARTITION BY prev) AS score FROM bg),
req AS (SELECT 'c' || CAST(conv_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS request_id, sentence AS text,
               regexp_replace({words('sentence')}[2], '[^\\pL]', '', 'g') AS word
        FROM conv_sentences WHERE len({words('sentence')}) >= 2),
requests AS (SELECT * FROM req WHERE word <> ''),
ending(pos, ends, put) AS (VALUES {endings}),
irregular(pos, form, base) AS (VALUES {irregular}),
plain AS (SELECT word, pos, replace(word, ' ', '_') AS form FROM (SELECT DISTINCT lower(word) AS word FROM requests), (VALUES {parts}) p(pos)),
detached(word, pos, form, step) AS (
  SELECT word, pos, form, 0 FROM plain ANTI JOIN irregular USING (pos, form)
  UNION SELECT d.word, d.pos, d.form[:length(d.form) - length(ends)] || put, step + 1
  FROM detached d JOIN ending e ON e.pos = d.pos AND ends_with(d.form, ends) WHERE step < {DETACH_DEPTH}),
forms AS (SELECT word, pos, form, greatest(step, 1) AS step FROM detached
          UNION SELECT word, pos, form, 1 FROM plain SEMI JOIN irregular USING (pos, form)
          UNION SELECT word, p.pos, base, 1 FROM plain p JOIN irregular i ON i.pos = p.pos AND i.form = p.form),
found AS (SELECT f.word, f.pos, f.form, f.step, s.synset_id FROM forms f JOIN word_synsets s ON s.word = f.form AND s.pos = f.pos),
senses AS (SELECT DISTINCT word, form, synset_id FROM (SELECT *, min(step) OVER (PARTITION BY word, pos) AS least FROM found)
           WHERE step = least)"""


def mask_sql(text: str, word: str) -> str:
    pat = f"'(?is)^(.*?)(^|{NONWORD})\\Q' || {word} || '\\E({NONWORD}|$)'"
    return f"regexp_replace({text}, {pat}, '\\1\\2[MASK]\\3')"


def cte_user_requests() -> str:
    return """req AS (SELECT 'r' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, text
        FROM conversations)"""


def drop_word_candidates(src: str, key: str, text: str, n: int = 8) -> str:
    """The stub generator in SQL: candidate g drops the g-th word."""
    return f"""rw AS (SELECT {key} AS k, {text} AS t, {words(text)} AS ws FROM {src}),
candidates AS (SELECT k AS sentence_id, t AS original, g.i::INTEGER AS gen_idx,
                      array_to_string(list_filter(ws, lambda w, j: j <> g.i + 1), ' ') AS text
               FROM rw, range(0, least(len(ws), {n})) g(i))"""


def tidy_sql(x: str) -> str:
    c = f"array_to_string({words(x)}, ' ')"
    return f"(CASE WHEN {c} = '' OR regexp_matches({c}, '[.!?]$') THEN {c} ELSE {c} || '.' END)"
