import itertools
import random

from pyspark.sql import functions as F

from paraforge.operators import simjoin
from paraforge.operators.simjoin import band_pairs, band_pairs_in_rows, candidate_pairs, token_prefixes

VOCAB = ["the", "a", "cat", "dog", "sat", "ran", "on", "mat", "x.", "y", "Le", "été"]


def jaccard(a, b):
    """By counting: words of either text, and words of both."""
    either = {w for t in (a, b) for w in t.lower().split()}
    both = [w for w in either if all(w in t.lower().split() for t in (a, b))]
    return len(both) / len(either) if a.split() and b.split() else 0.0


def brute_pairs(rows, lo, hi):
    by = {}
    for g, p, s in rows:
        by.setdefault(g, []).append((p, s))
    out = set()
    for g, items in by.items():
        for (p1, s1), (p2, s2) in itertools.combinations(sorted(items), 2):
            o = jaccard(s1, s2)
            if lo <= o <= hi:
                out.add((g, p1, p2, round(o, 9)))
    return out


def test_band_pairs_equals_all_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(6):
        size = 120 if g == 0 else rnd.randint(0, 25)   # group 0 is hot
        for p in range(size):
            n = rnd.randint(0, 7)
            rows.append((g, p, " ".join(rnd.choice(VOCAB) for _ in range(n))))
    rows += [(9, 0, "same line here"), (9, 1, "same line here"), (9, 2, "same line there")]
    df = spark.createDataFrame(rows, "cluster_id long, pos long, sentence string")
    for lo, hi in [(0.15, 0.45), (0.5, 1.0), (0.2, 0.2)]:
        got = {(r.cluster_id, r.pos1, r.pos2, round(r.overlap, 9))
               for r in band_pairs(df, "cluster_id", "pos", "sentence", lo, hi).collect()}
        assert got == brute_pairs(rows, lo, hi), (lo, hi)


def test_band_pairs_boundaries_inclusive(spark):
    # 3 shared of 20 distinct tokens -> exactly 0.15; 9 of 20 -> exactly 0.45
    a = " ".join(f"w{i}" for i in range(10)) + " s0 s1 s2"
    b = " ".join(f"v{i}" for i in range(7)) + " s0 s1 s2"
    rows = [(1, 0, a), (1, 1, b)]
    df = spark.createDataFrame(rows, "cluster_id long, pos long, sentence string")
    got = band_pairs(df, "cluster_id", "pos", "sentence", 0.15, 0.45).collect()
    assert len(got) == 1 and got[0].overlap == jaccard(a, b) == 0.15


def hot_rows(n=300):
    """One hot group: common words in almost every sentence, a few words of its own in each."""
    rnd = random.Random(8)
    rows = []
    for p in range(n):
        own = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(3, 9))]
        rows.append((1, p, " ".join(rnd.sample(["the", "of", "and", "a", "in"], rnd.randint(1, 4)) + own)))
    return rows


def test_posting_lists_are_split_and_positions_drop_candidates(spark, monkeypatch):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g long, p long, s string")
    base = df.withColumn("toks", simjoin._token_set("s")).withColumn("n", F.size("toks"))
    want = {r[1:3] for r in brute_pairs(rows, 0.15, 0.45)}
    prefixes = token_prefixes(base, 0.15)
    found = {}
    for postings in (16, 10_000):
        got = [tuple(r) for r in candidate_pairs(prefixes, 0.15, postings).select("p1", "p2").collect()]
        assert len(got) == len(set(got))
        found[postings] = set(got)
        assert want <= found[postings]
    assert found[16] == found[10_000]
    meets = prefixes.alias("a").join(prefixes.alias("b"), ["g", "tok"]).where("a.p < b.p").select("a.p", "b.p").distinct().count()
    # candidates per pair of the result, and against a join without the position filter
    assert len(found[16]) < 6 * len(want) and len(found[16]) < 0.8 * meets
    monkeypatch.setattr(simjoin, "POSTINGS", 16)
    got = {(r.g, r.pos1, r.pos2, round(r.overlap, 9)) for r in band_pairs(df, "g", "p", "s", 0.15, 0.45).collect()}
    assert got == brute_pairs(rows, 0.15, 0.45)


def test_pairs_inside_rows_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "ROW_BLOCK", 64)
    monkeypatch.setattr(simjoin, "TOKEN_BLOCK", 50)
    rnd = random.Random(2)
    groups = [[s for _, _, s in hot_rows(150)], [], ["one"], ["same line", "same line", "", None, "same"],
              [" ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(0, 7))) for _ in range(90)]]
    df = spark.createDataFrame([*enumerate(groups), (99, None)], "cluster_id long, sentences array<string>")
    flat = [(g, p, s or "") for g, ss in enumerate(groups) for p, s in enumerate(ss)]
    for lo, hi in [(0.15, 0.45), (0.5, 1.0), (0.2, 0.2)]:
        out = band_pairs_in_rows(df, "cluster_id", "sentences", lo, hi).collect()
        got = {(r.cluster_id, r.pos1, r.pos2, round(r.overlap, 9)) for r in out}
        assert len(got) == len(out) and got == brute_pairs(flat, lo, hi), (lo, hi)
        assert all(groups[r.cluster_id][r.pos1] == r.sentence1 and groups[r.cluster_id][r.pos2] == r.sentence2 for r in out)
    plan = band_pairs_in_rows(df, "cluster_id", "sentences", 0.5, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
