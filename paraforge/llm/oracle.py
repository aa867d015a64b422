"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from paraforge.llm.near_dup import SHINGLE
from paraforge.llm.search import B, EVERY, K1, TOP
from paraforge.llm.substrings import WINDOW

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM d, range(1, len(w) - {WINDOW - 2}) t(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, j FROM rep, range(i, i + {WINDOW}) t(j)),
word AS (SELECT r, j, w[j] AS x FROM d, range(1, len(w) + 1) t(j)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT r, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS s FROM d, range(1, greatest(len(w) - {SHINGLE - 2}, 2)) t(i)
       WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pair AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, step.b FROM reach JOIN step ON step.a = reach.o),
least AS (SELECT reach.r, min(d.doc_id) AS c FROM reach JOIN d ON d.r = reach.o GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, coalesce(doc_id = c, false) AS kept
FROM d JOIN least USING (r) LEFT JOIN n USING (r)"""

OP8 = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*)::DOUBLE AS f FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(f) AS l FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(l) FROM len) / (SELECT count(*) FROM documents) AS avg),
idf AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS i FROM tf, st GROUP BY w, n),
sc AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.f * i * d.f * {K1 + 1} / (d.f + {K1} * ({1 - B} + {B} * l / avg))), 6) AS score
       FROM tf q JOIN tf d USING (w) JOIN idf USING (w) JOIN len ON len.doc_id = d.doc_id, st WHERE q.doc_id % {EVERY} = 0 GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {TOP}"""

OP10 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(r, o) AS (SELECT r, r FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.o),
least AS (SELECT reach.r, min(v.vec_id) AS c FROM reach JOIN v ON v.r = reach.o GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN least USING (r) LEFT JOIN n USING (r)"""

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, doc_id, i, lines[i] AS x, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, range(1, len(lines) + 1) t(i)),
often AS (SELECT k, max(doc_id) AS holder FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
kept AS (SELECT r, string_agg(x, chr(10) ORDER BY i) AS t, count(*) AS n FROM line LEFT JOIN often USING (k)
         WHERE holder IS NULL OR doc_id = holder GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

# The unsigned crc32 of a decimal doc_id, bit by bit: a digit is mixed in, then eight shifts.
CRC = """xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
      lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _merkle_sql(levels: int = 8) -> str:
    """Levels are written out: 16 ** 8 leaves per source are far beyond what DuckDB is given here."""
    def field(c):
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    def up(level, over, groups):
        return (f"{over}{level + 1} AS (SELECT {groups}, i // 16 AS i, (max(n) + 15) // 16 AS n, string_agg(h, '' ORDER BY i) AS run, "
                f"sha256(string_agg(h, '' ORDER BY i)) AS h FROM {over}{level} WHERE n > 1 GROUP BY {groups}, i // 16)")

    def other(path, level, over, key):
        node = f"{over}{level + 1}"
        return (f"{path}{level + 1} AS (SELECT p.* REPLACE (CASE WHEN u.run IS NULL THEN f ELSE sha256(u.run[:64 * (pos % 16)] || f || "
                f"u.run[64 * (pos % 16 + 1) + 1:]) END AS f, CASE WHEN u.run IS NULL THEN proof ELSE proof || u.run[:64 * (pos % 16)] || "
                f"u.run[64 * (pos % 16 + 1) + 1:] END AS proof, pos // 16 AS pos) FROM {path}{level} p LEFT JOIN {node} u "
                f"ON u.{key} = p.{key} AND u.i = p.pos // 16)")

    plain = ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    lower = plain.replace(field("text"), field("low"))
    parts = [f"""d AS (SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      ELSE text END AS low FROM (SELECT *, {CRC} AS crc FROM documents))""",
             f"leaf AS (SELECT doc_id, source, sha256(concat({plain})) AS leaf, sha256(concat({lower})) AS start FROM d)",
             """l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf)""",
             "a0 AS (SELECT g, pos AS i, n, leaf AS h FROM l)"]
    parts += [up(k, "a", "g") for k in range(levels)]
    parts.append("sub AS (" + " UNION ALL ".join(f"SELECT g, h FROM a{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    parts.append("b0 AS (SELECT 0 AS z, g AS i, count(*) OVER () AS n, h FROM sub)")
    parts += [up(k, "b", "z") for k in range(levels)]
    parts.append("top AS (" + " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    parts.append("p0 AS (SELECT *, start AS f, '' AS proof FROM l)")
    parts += [other("p", k, "a", "g") for k in range(levels)]
    parts.append(f"q0 AS (SELECT * REPLACE (g AS pos), 0 AS z FROM p{levels})")
    parts += [other("q", k, "b", "z") for k in range(levels)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.h AS verified
FROM q{levels} q JOIN sub USING (g), top"""


OP12 = _merkle_sql()

OP13 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM w, range(1, 4) t(m), range(1, len(w) - m + 2) s(i) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE m > 1 AND f >= 10),
cut AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (1000000 * c.f::HUGEINT * c.f) // (x.f::HUGEINT * y.f) AS score
        FROM c, range(1, 3) t(k) JOIN g x ON x.lang = c.lang AND x.g = c.g[:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:] WHERE k < c.m),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
gone AS (SELECT c.lang, s.g FROM c JOIN c s ON s.lang = c.lang AND s.m = 2 AND c.m = 3 AND (s.g = c.g[:2] OR s.g = c.g[2:]) AND 100 * c.f >= 50 * s.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
  a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best ANTI JOIN gone USING (lang, g) JOIN n USING (lang) QUALIFY rank <= 2000"""
