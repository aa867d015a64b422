"""Substring dedup and near-duplicates against brute force on edge cases."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from paraforge.llm import near_dup, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stripped(rows, window):
    lists = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[j:j + window]) for w in lists for j in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, lists):
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone.update(range(j, j + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_repeated_windows_match_brute_force(edge_docs, edge_rows):
    for window in (35, 7, 2, 1):
        got = substrings._digest(substrings.strip_repeats(edge_docs.drop("ids"), window)).collect()
        assert Counter(map(tuple, got)) == stripped(edge_rows, window), window


def test_strip_keeps_input_columns(edge_docs):
    out = substrings.strip_repeats(edge_docs)
    assert set(edge_docs.columns) <= set(out.columns)
    assert out.filter("k1 = 5 AND spans = 'y'").count() == edge_docs.count()


def test_no_documents(no_docs):
    assert substrings.strip_repeats(no_docs).count() == 0
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert near_dup.one_of_each(no_docs).count() == 0


def shingles(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = WORD.findall(low)
    return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), least if sets[i] else doc_id, doc_id is not None and (not sets[i] or doc_id == least)))
    return Counter(out)


def test_near_duplicates_match_brute_force(edge_docs, edge_rows):
    got = near_dup.near_duplicates(edge_docs).drop("k1", "root").collect()
    assert Counter(map(tuple, got)) == linked(edge_rows)


def test_blocks_do_not_change_the_result(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    got = near_dup.near_duplicates(edge_docs).drop("k1", "root").collect()
    assert Counter(map(tuple, got)) == linked(edge_rows)


def test_one_of_each_group_stays(edge_docs, edge_rows):
    kept = near_dup.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(9) == 0 and ids.count(8) == 1 and None in ids
    assert kept.filter(F.col("doc_id").isin(12, 13, 15)).count() == 3
    again = near_dup.near_duplicates(kept).filter("n_shingles > 0 AND doc_id IS NOT NULL AND NOT kept")
    assert again.count() == 0


def test_register_estimates():
    import numpy as np

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    ra, rb = near_dup.registers([a, b])
    assert abs(near_dup.estimate((ra == rb).sum()) - 0.6) < 0.15
    far = near_dup.registers([np.sort(pool[:1000]), np.sort(pool[1000:2000])])
    assert near_dup.estimate((far[0] == far[1]).sum()) < 0.02


def near_copies(n, words=100):
    """n texts that differ from one text in one word each."""
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join(base[:i % words] + [f"own{i}"] + base[i % words + 1:])) for i in range(n)]


def test_edges_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    counts, real = {}, near_dup.stored

    def counted(df, name):
        out = real(df, name)
        if name.endswith("-edges"):
            counts[name] = counts.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(near_dup, "stored", counted)
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    seen = {}
    for n in (400, 800, 1600):
        counts.clear()
        rows = near_copies(n)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["component_id"] for r in got} == {0}
        seen[n] = dict(counts)
        # every band of a pass connects each member at most once, and a confirmed link connects two components
        assert counts["near-links-edges"] <= 2 * n and counts["near-likely-edges"] <= (near_dup.REGISTERS // near_dup.BAND + 4) * n
    for name in ("near-likely-edges", "near-links-edges"):
        assert seen[1600][name] <= 2.3 * seen[800][name] and seen[800][name] <= 2.3 * seen[400][name], (name, seen)


def test_groups_of_several_components_lose_no_link(spark, monkeypatch):
    """Chains, two groups that touch in one pair, and outsiders, in blocks far smaller than the groups."""
    import random

    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(70):  # a chain: each differs a little more from the first
        base = list(base)
        base[rng.randrange(60)] = f"c{i}"
        texts.append(" ".join(base))
    other = [f"v{i}" for i in range(40)] + base[:20]
    for i in range(60):
        copy = list(other)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(60)] = f"d{i}{rng.random()}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("k1", "root").collect()
    assert Counter(map(tuple, got)) == linked(rows)
