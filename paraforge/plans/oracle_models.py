"""DuckDB SQL of the default models behind the hooks: the decoding lattice (H1, H6), the corrector (H3) and the
Kneser-Ney score (H5). Each restates the operator's definition over whole tables, step by step in recursive queries."""

from __future__ import annotations

from paraforge.operators import acceptability as K
from paraforge.operators import correct as C
from paraforge.operators import decode as D
from paraforge.plans import oracle as O


def _clean(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\pL]', '', 'g')"


def cte_lattice(source: str, text: str) -> str:
    """``lat_text`` (id, t, n), ``lat_choice`` (id, place, b, c, shown) and ``lat_odds`` (id, place, a, b, p); needs ``bigram``."""
    return f"""lat_text AS (SELECT row_number() OVER () AS id, t, {O.words('t')} AS ws, len({O.words('t')}) AS n
  FROM (SELECT DISTINCT {text} AS t FROM {source}) WHERE len({O.words('t')}) > 0),
lat_place AS (SELECT id, i - 1 AS place, ws[i] AS w, {_clean('ws[i]')} AS c, CASE WHEN i > 1 THEN {_clean('ws[i - 1]')} END AS before
  FROM lat_text, range(1, n + 1) r(i)),
lat_next AS (SELECT prev, token, row_number() OVER (PARTITION BY prev ORDER BY score DESC, token) AS rk FROM bigram QUALIFY rk <= {D.SUBSTITUTES}),
lat_choice AS (SELECT id, place, 0 AS b, c, w AS shown FROM lat_place
  UNION ALL SELECT id, place, row_number() OVER (PARTITION BY id, place ORDER BY rk) AS b, token, token
  FROM lat_place JOIN lat_next ON prev = before WHERE token <> c),
lat_odds AS (SELECT id, 0 AS place, 0 AS a, 0 AS b, 1.0::DOUBLE AS p FROM lat_text
  UNION ALL SELECT y.id, y.place, x.b, y.b, CASE WHEN y.b = 0 THEN {D.COPY}::DOUBLE ELSE 0.0::DOUBLE END + {1 - D.COPY}::DOUBLE * coalesce(g.score, 0)
  FROM lat_choice x JOIN lat_choice y ON y.id = x.id AND y.place = x.place + 1 LEFT JOIN bigram g ON g.prev = x.c AND g.token = y.c
  WHERE y.b = 0 OR g.score > 0)"""


def cte_searches() -> str:
    """``beam_out`` and ``diverse_out`` (id, path) over the lattice."""
    fine = round(D.DIVERSITY * D.UNIT)
    groups = ", ".join(["0"] * D.BEAMS)
    return f"""beam(id, place, rk, last, score, path) AS (SELECT id, -1, 0, 0, 0::BIGINT, []::BIGINT[] FROM lat_text
  UNION ALL SELECT id, place, rk, b, score, path FROM (SELECT s.id, o.place, o.b, s.score + round(ln(o.p) * {D.UNIT})::BIGINT AS score,
    list_append(s.path, o.b) AS path, row_number() OVER (PARTITION BY s.id ORDER BY s.score + round(ln(o.p) * {D.UNIT})::BIGINT DESC, s.rk, o.b) - 1 AS rk
    FROM beam s JOIN lat_odds o ON o.id = s.id AND o.place = s.place + 1 AND o.a = s.last) WHERE rk < {D.BEAMS}),
beam_out AS (SELECT id, path FROM beam JOIN lat_text USING (id) WHERE place = n - 1 AND rk = 0),
diverse(id, step, scores, lasts, paths, taken) AS (
  SELECT id, 0, [{groups}]::BIGINT[], [{groups}]::BIGINT[], [{', '.join(['[]'] * D.BEAMS)}]::BIGINT[][], []::BIGINT[] FROM lat_text
  UNION ALL SELECT id, step + 1, list_transform(scores, lambda x, k: CASE WHEN k = g THEN score ELSE x END),
    list_transform(lasts, lambda x, k: CASE WHEN k = g THEN b ELSE x END),
    list_transform(paths, lambda x, k: CASE WHEN k = g THEN list_append(x, b) ELSE x END),
    CASE WHEN g = {D.BEAMS} THEN []::BIGINT[] ELSE list_append(taken, b) END
  FROM (SELECT s.*, s.step % {D.BEAMS} + 1 AS g, o.b AS b,
          s.scores[s.step % {D.BEAMS} + 1] + round(ln(o.p) * {D.UNIT})::BIGINT - {fine} * len(list_filter(s.taken, lambda x: x = o.b)) AS score
        FROM diverse s JOIN lat_odds o ON o.id = s.id AND o.place = s.step // {D.BEAMS} AND o.a = s.lasts[s.step % {D.BEAMS} + 1]
        QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY score DESC, o.b) = 1)),
diverse_out AS (SELECT id, paths[list_position(scores, list_max(scores))] AS path FROM diverse JOIN lat_text USING (id) WHERE step = n * {D.BEAMS})"""


def cte_samples(n: int) -> str:
    """``sample_out`` (id, number, path) over the lattice."""
    share = round(D.TOP_P * D.UNIT)
    return f"""sampled(id, number, place, last, path) AS (SELECT id, s, -1, 0, []::BIGINT[] FROM lat_text, range(0, {n}) r(s)
  UNION ALL SELECT id, number, place, b, list_append(path, b) FROM (
    SELECT *, ('0x' || substr(md5('{D.SEED}:' || t || ':' || number || ':' || place), 1, 8))::BIGINT * sum(w) OVER (PARTITION BY id, number) >> 32 AS draw
    FROM (SELECT s.id, t, s.number, o.place, o.b, s.path, round(pow(o.p, {1 / D.TEMPERATURE!r}) * {D.UNIT})::BIGINT AS w,
            coalesce(sum(round(pow(o.p, {1 / D.TEMPERATURE!r}) * {D.UNIT})::BIGINT) OVER (PARTITION BY s.id, s.number
              ORDER BY round(pow(o.p, {1 / D.TEMPERATURE!r}) * {D.UNIT})::BIGINT DESC, o.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
            sum(round(pow(o.p, {1 / D.TEMPERATURE!r}) * {D.UNIT})::BIGINT) OVER (PARTITION BY s.id, s.number)::BIGINT AS whole
          FROM sampled s JOIN lat_odds o ON o.id = s.id AND o.place = s.place + 1 AND o.a = s.last JOIN lat_text x ON x.id = s.id)
    WHERE below * {D.UNIT} < whole * {share}) WHERE below <= draw AND draw < below + w),
sample_out AS (SELECT id, number, path FROM sampled JOIN lat_text USING (id) WHERE place = n - 1)"""


def shown(table: str) -> str:
    """(t, *, out): the paths of ``table`` as texts."""
    return f"""SELECT t, x.*, (SELECT string_agg(shown, ' ' ORDER BY place) FROM lat_choice c WHERE c.id = x.id AND c.b = x.path[c.place + 1]) AS out
FROM {table} x JOIN lat_text USING (id)"""


# Letters beyond a-z of the given tables, each as one other character: DuckDB's edit distance counts bytes.
LETTERS, SINGLE = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "0123456789!#$%&()*+,-./:;<=>?@["


def cte_corrected(source: str, text: str) -> str:
    """``fixed`` (t, corrected); needs ``cw`` (w) and ``bigram``."""
    def plain(x):
        return f"translate({x}, '{LETTERS}', '{SINGLE}')"

    return f"""cx_text AS (SELECT row_number() OVER () AS id, t, {O.words('t')} AS ws FROM (SELECT DISTINCT {text} AS t FROM {source}) WHERE len({O.words('t')}) > 0),
cx_place AS (SELECT id, i - 1 AS place, ws[i] AS w, lower(regexp_extract(ws[i], '^([^\\pL]*)(\\pL+)([^\\pL]*)$', 2)) AS c FROM cx_text, range(1, len(ws) + 1) r(i)),
cx_count AS (SELECT w AS word, count(*) AS n FROM cw GROUP BY w),
cx_total AS (SELECT sum(n)::DOUBLE AS total FROM cx_count),
cx_known AS (SELECT * FROM cx_count WHERE n >= {C.MIN_COUNT}),
cx_unknown AS (SELECT DISTINCT c AS word FROM cx_place WHERE length(c) > 2 AND c NOT IN (SELECT word FROM cx_known)),
cx_pair AS (SELECT u.word, v.word AS candidate, n, levenshtein({plain('u.word')}, {plain('v.word')}) AS d
  FROM cx_unknown u JOIN cx_known v ON abs(length(u.word) - length(v.word)) <= 2 WHERE levenshtein({plain('u.word')}, {plain('v.word')}) <= 2),
cx_edit AS (SELECT word, candidate, n, CASE WHEN d = 2 AND length(word) = length(candidate) AND list_contains(list_transform(range(1, length(word)),
    lambda i: word[:i - 1] || word[i + 1] || word[i] || word[i + 2:]), candidate) THEN 1 ELSE d END AS d FROM cx_pair),
cx_near AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, n DESC, candidate) AS rank FROM cx_edit
  WHERE d <= CASE WHEN length(word) <= {C.SHORT} THEN 1 ELSE 2 END QUALIFY rank <= {C.CANDIDATES}),
cx_choice AS (SELECT id, place, 0 AS b, c, w, CASE WHEN c IN (SELECT word FROM cx_near) THEN round(ln(0.5) * {C.UNIT})::BIGINT - round(ln(total) * {C.UNIT})::BIGINT
    ELSE 0 END AS s FROM cx_place, cx_total
  UNION ALL SELECT id, place, rank, candidate, w, round((ln(n / total) - {C.EDIT_COST} * d) * {C.UNIT})::BIGINT FROM cx_place JOIN cx_near ON word = c, cx_total),
cx_doubt AS (SELECT DISTINCT id, place FROM cx_choice WHERE b > 0),
cx_step AS (SELECT y.id, y.place, x.b AS a, y.b, y.s + CASE WHEN dx.id IS NULL AND dy.id IS NULL THEN 0 WHEN coalesce(g.score, 0) = 0 THEN round(ln({C.FLOOR}) * {C.UNIT})::BIGINT
    ELSE round(ln({C.FLOOR} + {1 - C.FLOOR} * g.score) * {C.UNIT})::BIGINT END AS s
  FROM cx_choice x JOIN cx_choice y ON y.id = x.id AND y.place = x.place + 1 LEFT JOIN cx_doubt dx ON dx.id = x.id AND dx.place = x.place
  LEFT JOIN cx_doubt dy ON dy.id = y.id AND dy.place = y.place LEFT JOIN bigram g ON g.prev = x.c AND g.token = y.c
  WHERE x.id IN (SELECT id FROM cx_doubt)),
cx_path(id, place, b, total, path) AS (SELECT id, place, b, s, [b] FROM cx_choice WHERE place = 0 AND id IN (SELECT id FROM cx_doubt)
  UNION ALL SELECT id, place, b, total, path FROM (SELECT s.id, o.place, o.b, s.total + o.s AS total, list_append(s.path, o.b) AS path,
    row_number() OVER (PARTITION BY s.id, o.b ORDER BY s.total + o.s DESC, s.b) AS rn
    FROM cx_path s JOIN cx_step o ON o.id = s.id AND o.place = s.place + 1 AND o.a = s.b) WHERE rn = 1),
cx_best AS (SELECT p.id, p.path FROM cx_path p JOIN cx_text t USING (id) WHERE p.place = len(t.ws) - 1
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY total DESC, b) = 1),
cx_word AS (SELECT id, place, CASE WHEN b = 0 THEN w ELSE regexp_replace(w, '\\pL+', CASE
    WHEN length(k) > 1 AND k = upper(k) AND k <> lower(k) THEN upper(c) WHEN k[1] = upper(k[1]) AND k[1] <> lower(k[1]) THEN upper(c[1]) || c[2:] ELSE c END) END AS w
  FROM (SELECT c.*, regexp_extract(w, '\\pL+') AS k FROM cx_choice c JOIN cx_best p ON p.id = c.id AND p.path[c.place + 1] = c.b)
  UNION ALL SELECT id, place, w FROM cx_place WHERE id NOT IN (SELECT id FROM cx_doubt)),
cx_out AS (SELECT id, string_agg(w, ' ' ORDER BY place) AS o FROM cx_word GROUP BY id),
fixed AS (SELECT t, CASE WHEN regexp_matches(o, '[.!?]$') THEN o ELSE o || '.' END AS corrected FROM cx_text JOIN cx_out USING (id))"""


def cte_kneser_ney(source: str, text: str) -> str:
    """``kn_out`` (t, label, score) of each distinct text with a word (order 3)."""
    def marked(x):
        return f"list_concat(['{K.START}', '{K.START}'], {x}, ['{K.END}'])"

    def per_order(k):
        return f"""kn_x{k} AS (SELECT ctx, sum(c) AS total, count(*) AS types FROM kn_g{k} GROUP BY ctx),
kn_d{k} AS (SELECT CASE WHEN one > 0 AND two > 0 THEN one / (one + 2 * two) ELSE 0.5 END AS d FROM (SELECT count_if(c = 1)::DOUBLE AS one, count_if(c = 2)::DOUBLE AS two FROM kn_g{k}))"""

    def lower(k):
        return f"kn_g{k} AS (SELECT regexp_replace(ctx, '^[^ ]* ?', '') AS ctx, word, count(*) AS c FROM kn_g{k + 1} GROUP BY ALL)"

    def step(k, below):
        return f"""kn_p{k} AS (SELECT p.*, CASE WHEN x.total IS NULL THEN {below} ELSE greatest(coalesce(g.c, 0) - d, 0) / x.total + d * x.types / x.total * {below} END AS p{k}
  FROM kn_p{k - 1} p LEFT JOIN kn_g{k} g ON g.ctx = p.c{k} AND g.word = p.word LEFT JOIN kn_x{k} x ON x.ctx = p.c{k}, kn_d{k})"""

    fold = f"('0x' || substr(md5('fold:' || t), 1, 4))::INTEGER % {K.FOLDS} = 0"
    return f"""kn_row AS (SELECT {text} AS t, {O.words(f'lower({text})')} AS ws FROM {source}),
kn_g3 AS (SELECT w[i - 2] || ' ' || w[i - 1] AS ctx, w[i] AS word, count(*) AS c FROM (SELECT {marked('ws')} AS w FROM kn_row WHERE len(ws) > 0 AND NOT ({fold})) m,
  range(3, len(w) + 1) r(i) GROUP BY ALL),
{lower(2)},
{lower(1)},
{per_order(3)},
{per_order(2)},
{per_order(1)},
kn_text AS (SELECT row_number() OVER () AS id, t, ws FROM (SELECT DISTINCT t, ws FROM kn_row WHERE len(ws) > 0)),
kn_mixed AS (SELECT -id AS id, list_transform(list_sort(list_transform(ws, lambda w, i: {{'k': md5('{K.SEED}:' || w || ':' || (i - 1)), 'i': i, 'w': w}})), lambda x: x.w) AS ws
  FROM kn_text WHERE {fold} AND len(ws) > 1),
kn_p0 AS (SELECT id, w[i] AS word, '' AS c1, w[i - 1] AS c2, w[i - 2] || ' ' || w[i - 1] AS c3, 1.0::DOUBLE / ((SELECT count(*) FROM kn_g1) + 1) AS p0
  FROM (SELECT id, {marked('ws')} AS w FROM (SELECT id, ws FROM kn_text UNION ALL SELECT * FROM kn_mixed)) m, range(3, len(w) + 1) r(i)),
{step(1, 'p0')},
{step(2, 'p1')},
{step(3, 'p2')},
kn_score AS (SELECT id, avg(ln(p3)) AS score FROM kn_p3 GROUP BY id),
kn_fold AS (SELECT floor(s.score * 100) AS bucket, count_if(s.id > 0) AS good, count_if(s.id < 0) AS bad
  FROM kn_score s WHERE s.id IN (SELECT id FROM kn_mixed UNION ALL SELECT -id FROM kn_mixed) GROUP BY ALL),
kn_cut AS (SELECT bucket FROM (SELECT bucket, sum(good) OVER (ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    + coalesce(sum(bad) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM kn_fold) ORDER BY r DESC, bucket LIMIT 1),
kn_out AS (SELECT t, CASE WHEN floor(score * 100) >= (SELECT bucket FROM kn_cut) THEN 'acceptable' ELSE 'unacceptable' END AS label, score
  FROM kn_text JOIN kn_score USING (id))"""
