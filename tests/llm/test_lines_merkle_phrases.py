"""Line dedup, the Merkle manifest and collocations against plain Python on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paraforge.llm import collocations, lines, merkle

BLANK = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Line dedup ---------------------------------------------------------------------------------------------


def deduped(rows, min_chars, min_docs):
    held = defaultdict(list)
    split = [(i, (t or "").split("\n")) for i, t in rows]

    def key(line):
        return line.strip(BLANK).translate(LOWER)
    for i, ls in split:
        for k in {key(x) for x in ls}:
            if len(k) >= min_chars:
                held[k].append(i)
    holder = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, ls in split:
        kept = [x for x in ls if key(x) not in holder or holder[key(x)] == i]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def line_rows(edge_rows):
    rng = random.Random(3)
    pool = ["Subscribe to our NEWSLETTER today", "  subscribe to our newsletter today\t", "all rights reserved, every one", "short",
            "x" * 20, "x" * 19, "é" * 20, "É" * 20, "", " ", "same line " * 30]
    rows = list(edge_rows)
    for i in range(300, 420):
        rows.append((i if i % 9 else None, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()} of this one"
                                                     for _ in range(rng.randrange(1, 8)))))
    rows.append((1000, "\n".join(["all rights reserved, every one"] * 5000 + ["end\r"])))
    rows += [(501, "the very same row, repeated\nx")] * 4
    rows += [(None, "only in rows without an id, three times")] * 3
    return rows


@pytest.mark.parametrize("min_chars,min_docs,batches", [(20, 3, 4), (1, 2, 5), (20, 3, 1)])
def test_line_dedup_matches_brute_force(spark, edge_rows, min_chars, min_docs, batches):
    rows = line_rows(edge_rows)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h1 long, n long").repartition(5)
    got = lines.drop_repeated_lines(docs, min_chars, min_docs, batches).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    assert Counter(map(tuple, got.collect())) == deduped(rows, min_chars, min_docs)


def test_line_dedup_without_rows(no_docs):
    assert lines.drop_repeated_lines(no_docs).count() == 0


def test_runs_are_levelled_sorted_and_settled_keys_stay_out(spark):
    runs, sizes = lines.LineRuns(spark, 3), []
    for b in range(7):
        batch = spark.range(20).selectExpr("id AS h1", f"CAST(CASE WHEN id < 10 THEN 0 ELSE {b} END AS BIGINT) AS h2",
                                           "CASE WHEN id < 5 THEN 3L ELSE 1L END AS n", f"{100 - b}L AS holder")
        runs.add(batch)
        sizes.append([None if r is None else r.count() for r in runs.levels])
    # Three runs of 4, 2 and 1 batches; the five keys settled by batch 0 are in no later run.
    assert [r is not None for r in runs.levels] == [True, True, True]
    assert sizes[0] == [20] and sizes[2][0] == 15
    known = {(r.h1, r.h2): (r.n, r.holder) for r in runs.compacted().collect()}
    assert len(known) == 5 + 5 + 70
    assert known[(0, 0)] == (3, 100) and known[(7, 0)][0] >= 3 and known[(7, 0)][1] == 100 and known[(15, 6)] == (1, 94)
    plan = runs.runs()[0].join(runs.runs()[0].hint("merge"), runs.KEY, "left_anti")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


# Merkle manifest ----------------------------------------------------------------------------------------


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(rows):
    """Every leaf's proof and folded root by plain recursion over lists."""
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([sha("".join(now[i:i + 16])) for i in range(0, len(now), 16)])
        return levels

    def path(levels, at, start, proof):
        for level in levels[:-1]:
            run = level[at // 16 * 16:at // 16 * 16 + 16]
            before, after = run[:at % 16], run[at % 16 + 1:]
            proof += before + after
            start, at = sha("".join(before + [start] + after)), at // 16
        return start, proof

    groups = defaultdict(list)
    for row in rows:
        changed = list(row)
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
            changed[4] = row[4].translate(LOWER)
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), leaf_of(changed)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for at, (has, doc_id, leaf, start) in enumerate(sorted(groups[s])):
            folded, proof = path(trees[s], at, start, [])
            folded, proof = path(top, g, folded, proof)
            out.append((doc_id if has else None, leaf, trees[s][-1][0], top[-1][0], sha("".join(proof)), folded, folded == top[-1][0]))
    return Counter(out)


def merkle_rows(kind, edge_rows):
    if kind == "edge":
        return [(i, None if n % 7 == 0 else ["", "s1", "s2", "é"][n % 4], None if n % 5 == 0 else "en", n if n % 3 else None, t)
                for n, (i, t) in enumerate(edge_rows)]
    if kind == "one source":
        return [(i, "s", "en", i, f"Text {i}") for i in range(16 ** 3 // 4 + 17)]
    if kind == "many sources":
        return [(i, f"s{i % 40}" if i % 3 else f"own{i}", "en", i, f"Text {i}") for i in range(500)]
    return [(7, None, None, None, "One Text")]


@pytest.mark.parametrize("kind", ["edge", "one source", "many sources", "one row"])
def test_manifest_matches_plain_recursion(spark, edge_rows, monkeypatch, kind):
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", 1)  # so that nodes have several chunks below them
    rows = merkle_rows(kind, edge_rows)
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place long, run string")
    text = F.when(merkle.tampered(F.col("doc_id")), F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    found = merkle.climb(merkle.build(docs.repartition(4), changed={"text": text}))
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", F.col("folded_root") == F.col("root"))
    assert Counter(map(tuple, got.collect())) == climbed(rows)


def test_manifest_without_rows(no_docs):
    assert merkle.climb(merkle.build(no_docs)).count() == 0


# Collocations -------------------------------------------------------------------------------------------


def mined(rows, longest, least, absorbed, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, a in found.items():
            for m in range(2, len(g)):
                gone.update(x for x in (g[i:i + m] for i in range(len(g) - m + 1)) if 100 * a >= absorbed * f[x])
        best = []
        for g, a in found.items():
            if g not in gone:
                score, k = min(((10 ** 6 * a * a) // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def phrase_rows(edge_rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["The", "the", "Été", "a\0b", "a", "a\x01", "\x01", "\x01\x02", "b-c"]
    rows = [(None if n % 4 == 0 else ["en", "de"][n % 2], t) for n, (_, t) in enumerate(edge_rows)]
    for i in range(150):
        rows.append((rng.choice(["en", "de", None, "z\0"]), rng.choice([" ", "  ", "\t"]).join(
            rng.choice(vocabulary) + (rng.choice(".,;:!?\n\r") if rng.random() < 0.1 else "") for _ in range(rng.randrange(60)))))
    return rows + [("en", "new york city " * 40), ("en", "hot " * 3000)]


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (2, 2, 7), (4, 3, 100)])
def test_collocations_match_brute_force(spark, edge_rows, monkeypatch, longest, least, top):
    monkeypatch.setattr(collocations, "RUN_WORDS", 500)
    rows = phrase_rows(edge_rows)
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "lang string, text string, n long, key long").repartition(3)
    got = collocations.collocations(docs, longest, least, 50, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == mined(rows, longest, least, 50, top)


def test_collocations_without_rows(no_docs):
    assert collocations.collocations(no_docs).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [("en", "big pair " * 40_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(docs, 2).select("phrase", "a", "l", "r", "score").collect()
    assert {tuple(r) for r in got} == {("big pair", 40_000, 40_000, 40_000, 10 ** 6),
                                       ("pair big", 39_999, 40_000, 40_000, 10 ** 6 * 39_999 ** 2 // 40_000 ** 2)}
