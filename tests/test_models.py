"""The default models behind the hooks against plain Python on small tables."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from paraforge.operators import acceptability as K
from paraforge.operators import correct as E
from paraforge.operators import decode as D

BIGRAMS = [("i", "am", 0.5), ("i", "was", 0.3), ("i", "will", 0.15), ("i", "do", 0.05), ("am", "very", 0.4), ("am", "so", 0.6),
           ("was", "very", 0.9), ("was", "so", 0.1), ("very", "happy", 0.2), ("very", "tired", 0.7), ("so", "tired", 0.3),
           ("so", "happy", 0.4), ("so", "glad", 0.3), ("happy", "today", 1.0)]
TEXTS = ["I am very happy today.", "i was so", "One", "  ", None, "Nothing is known here", "I, am! 12 very", "I am very happy today."]


@pytest.fixture(scope="module")
def bigrams(spark):
    return spark.createDataFrame(BIGRAMS, "prev string, token string, score double")


def clean(word):
    return "".join(c for c in word.lower() if c.isalpha())


def choices(words):
    """Choices (token, shown) at each place, built again from the bigram list."""
    out = []
    for i, w in enumerate(words):
        subs = []
        if i:
            follow = sorted(((-s, t) for p, t, s in BIGRAMS if p == clean(words[i - 1])))[:D.SUBSTITUTES]
            subs = [t for _, t in follow if t != clean(w)]
        out.append([(clean(w), w)] + [(t, t) for t in subs])
    return out


def odds(options, i, a, b):
    share = {(p, t): s for p, t, s in BIGRAMS}.get((options[i - 1][a][0], options[i][b][0]), 0.0)
    return (D.COPY if b == 0 else 0.0) + (1 - D.COPY) * share


def all_paths(options):
    for path in itertools.product(*[range(len(o)) for o in options]):
        ps = [1.0] + [odds(options, i, path[i - 1], path[i]) for i in range(1, len(path))]
        if path[0] == 0 and all(p > 0 for p in ps):
            yield path, ps


def shown(options, path):
    return " ".join(options[i][b][1] for i, b in enumerate(path))


def test_searches_and_samples_match_all_paths(spark, bigrams, monkeypatch):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {(r.text, r.strategy, r.idx): r.candidate for r in D.decode(texts, bigrams, samples=40).collect()}
    again = {(r.text, r.strategy, r.idx): r.candidate for r in D.decode(texts.repartition(3), bigrams, samples=40).collect()}
    assert got == again
    real = {t for t in TEXTS if t and t.strip()}
    assert {k[0] for k in got} == real and len(got) == len(real) * 42
    for text in real:
        options = choices(text.split())
        paths = list(all_paths(options))
        best = max(paths, key=lambda x: sum(round(math.log(p) * D.UNIT) for p in x[1]))
        lattice = D.Lattice(text, text.split(), [[t for t, _ in o[1:]] for o in options],
                            [{"place": i, "a": a, "b": b, "share": s} for i in range(1, len(options)) for a, x in enumerate(options[i - 1])
                             for b, y in enumerate(options[i]) for p, t, s in BIGRAMS if (p, t) == (x[0], y[0])])
        assert shown(options, D.beam(lattice, 10_000)) == shown(options, best[0])
        assert got[text, "beam", 0] == shown(options, D.beam(lattice))
        possible = {shown(options, path) for path, _ in paths}
        assert got[text, "diverse", 0] in possible and {got[text, "sample", n] for n in range(40)} <= possible
        for n in range(40):
            assert got[text, "sample", n] == shown(options, drawn(options, text, n))


def drawn(options, text, number):
    path = [0]
    for i in range(1, len(options)):
        weights = {b: round(odds(options, i, path[-1], b) ** (1 / D.TEMPERATURE) * D.UNIT) for b in range(len(options[i]))}
        order = sorted((b for b in weights if odds(options, i, path[-1], b) > 0), key=lambda b: (-weights[b], b))
        whole, kept = sum(weights[b] for b in order), []
        for b in order:
            if sum(weights[x] for x in kept) < D.TOP_P * whole:
                kept.append(b)
        u = int(md5(f"{D.SEED}:{text}:{number}:{i}".encode()).hexdigest()[:8], 16) * sum(weights[b] for b in kept) >> 32
        below = 0
        for b in kept:
            if below <= u < below + weights[b]:
                path.append(b)
                break
            below += weights[b]
    return path


def test_groups_avoid_each_others_choices():
    steps = [{"place": 1, "a": 0, "b": b, "share": s} for b, s in [(0, 0.1), (1, 0.5), (2, 0.3)]]
    lattice = D.Lattice("x y", ["x", "y"], [[], ["p", "q"]], steps)
    taken = [D.diverse(lattice, g, 10.0) for g in (1, 2, 3)]
    assert taken[0] == [0, 0] and all(t == [0, 0] for t in taken)  # the first group's path costs no penalty
    assert D.beam(lattice) == [0, 0] and D.diverse(lattice, 4, 0.0) == [0, 0]


def test_candidates_come_back_per_request(spark, bigrams):
    reqs = spark.createDataFrame([("r1", TEXTS[0]), ("r2", TEXTS[0]), ("r3", None), ("r4", "")], "sentence_id string, original string")
    out = D.sampled_candidates(reqs, bigrams, n=5).collect()
    by = defaultdict(dict)
    for r in out:
        by[r.sentence_id][r.gen_idx] = r.text
    assert set(by) == {"r1", "r2"} and by["r1"] == by["r2"] and set(by["r1"]) == set(range(5))


def test_texts_meet_the_bigrams_in_blocks(spark, bigrams, monkeypatch):
    texts = spark.createDataFrame([(f"{t} {i % 3}",) for i, t in enumerate(TEXTS * 4) if t], "text string")
    rows = lambda: sorted(tuple(r) for r in D.decode(texts, bigrams, samples=4).collect())
    expected = rows()
    monkeypatch.setattr(D, "BLOCK_WORDS", 32)
    assert D._blocks(texts)[1] > 2 and rows() == expected and len(expected) > 20
    # A text meets its rewrites as one list, which is unrolled after the join: no row a rewrite is shuffled.
    reqs = texts.select(D.F.monotonically_increasing_id().alias("sentence_id"), D.F.col("text").alias("original"))
    for out in (D.sampled_candidates(reqs, bigrams, n=5), D.decoded_strategies(reqs, bigrams)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate posexplode(candidates") < plan.index("Join Inner")


def test_a_choice_is_worked_out_once_for_all_samples(monkeypatch):
    steps = [{"place": i, "a": a, "b": b, "share": 0.2 + b / 10} for i in range(1, 30) for a in range(3) for b in range(3)]
    lattice, asked = D.Lattice("x " * 30, ["x"] * 30, [[]] + [["p", "q"]] * 29, steps), []
    odds = D.Lattice.odds
    monkeypatch.setattr(D.Lattice, "odds", lambda self, place, before: asked.append((place, before)) or odds(self, place, before))
    paths = {tuple(D.sample(lattice, n)) for n in range(40)}
    D.beam(lattice), D.diverse(lattice)
    assert len(paths) > 20 and max(asked.count(x) for x in asked) <= 2  # once for the samples, once for the searches


# Corrector ----------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2:] for i in range(len(a) - 1)}
    return 1 if row[-1] == 2 and b in swaps else row[-1]


COUNTS = {"the": 50, "then": 9, "than": 7, "quick": 5, "quiet": 4, "quite": 12, "fox": 6, "over": 8, "lazy": 3, "größe": 4, "rare": 2, "a": 30,
          "straße": 3, "strasse": 9}
PAIRS = [("the", "quick", 0.5), ("quick", "fox", 0.6), ("quite", "lazy", 0.4), ("over", "the", 0.9), ("the", "lazy", 0.2), ("is", "quite", 0.3)]


def near(word):
    limit = 1 if len(word) <= E.SHORT else 2
    found = [(distance(word, v), -n, v) for v, n in COUNTS.items() if n >= E.MIN_COUNT]
    return [(v, d, -n) for d, n, v in sorted(f for f in found if 1 <= f[0] <= limit)[:E.CANDIDATES]] if len(word) > 2 else []


def test_candidates_match_all_distances(spark):
    rng = random.Random(6)
    words = {"teh", "quik", "quikc", "foxx", "ovr", "lzay", "grösse", "strase", "zzzzz", "qu", "x", "thann", "rare"}
    for v in COUNTS:
        for _ in range(6):
            w = list(v)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(w) + 1)
                w[i:i + rng.randrange(2)] = rng.choice(["", "a", "e", "ü", "q"])
            words.add("".join(w))
    words = {w for w in words if w and COUNTS.get(w, 0) < E.MIN_COUNT}
    vocabulary = spark.createDataFrame(list(COUNTS.items()), "word string, n long").filter(F.col("n") >= E.MIN_COUNT)
    got = E.correction_candidates(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.word].append((r.candidate, r.distance, r.n))
    assert {w: by.get(w, []) for w in words} == {w: near(w) for w in words}


def corrected(text):
    words, total = text.split(), sum(COUNTS.values())
    share = {(p, t): s for p, t, s in PAIRS}

    def letters(w):
        k = w.strip("".join(c for c in w if not c.isalpha()))
        return k.lower() if k.isalpha() else ""
    options = []
    for w in words:
        k = letters(w)
        found = near(k) if k and COUNTS.get(k, 0) < E.MIN_COUNT else []
        own = round(math.log(0.5) * E.UNIT) - round(math.log(total) * E.UNIT) if found else 0
        options.append([(k, own)] + [(v, round((math.log(n / total) - E.EDIT_COST * d) * E.UNIT)) for v, d, n in found])

    def worth(path):
        out = sum(options[i][b][1] for i, b in enumerate(path))
        for i in range(1, len(path)):
            if len(options[i]) > 1 or len(options[i - 1]) > 1:
                s = share.get((options[i - 1][path[i - 1]][0], options[i][path[i]][0]), 0)
                out += round(math.log(E.FLOOR + (1 - E.FLOOR) * s if s else E.FLOOR) * E.UNIT)
        return out
    best = max(itertools.product(*[range(len(o)) for o in options]), key=lambda p: (worth(p), [-b for b in p]))
    out = []
    for w, b, o in zip(words, best, options):
        if b:
            at = [i for i, c in enumerate(w) if c.isalpha()]
            old, new = w[at[0]:at[-1] + 1], o[b][0]
            new = new.upper() if len(old) > 1 and old.isupper() else new[0].upper() + new[1:] if old[0].isupper() else new
            w = w[:at[0]] + new + w[at[-1] + 1:]
        out.append(w)
    line = " ".join(out)
    return line if line[-1] in ".!?" else line + "."


def test_corrections_match_all_paths(spark):
    texts = ["Teh quikc fox", "  over  teh lzay (foxx)!", "TEH quick", "all of this is unknwon", "is quiet lazi", "Größ 12 quik-quik quikk?", "x",
             "the quick fox.", "Strase, strase", " ", None, "Teh quikc fox", "ovr teh " * 4]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = spark.createDataFrame(list(COUNTS.items()), "word string, n long")
    got = {r.text: r.corrected for r in E.corrected_texts(rows, counts, spark.createDataFrame(PAIRS, "prev string, token string, score double")).collect()}
    assert got == {t: corrected(t) for t in texts if t and t.strip()}
    assert got["Teh quikc fox"] == "The quick fox." and got["the quick fox."] == "the quick fox."


def test_best_path_ties_go_to_the_earlier_choice():
    assert E.best_path([[(0, 1), (1, 1)], [(0, 2), (2, 2)]], lambda i, a, b: 0) == [0, 0]


# Acceptability ------------------------------------------------------------------------------------------


def kneser_ney(sentences, order):
    grams = {order: Counter()}
    for s in sentences:
        w = [K.START] * (order - 1) + s.lower().split() + [K.END]
        grams[order].update(tuple(w[i - order + 1:i + 1]) for i in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discount = {}
    for k, table in grams.items():
        one, two = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount[k] = one / (one + 2 * two) if one and two else 0.5
    contexts = {k: defaultdict(list) for k in grams}
    for k, table in grams.items():
        for g, c in table.items():
            contexts[k][g[:-1]].append(c)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(grams[1]) + 1)
        below = p(gram[1:])
        seen = contexts[k].get(gram[:-1])
        if not seen:
            return below
        return max(grams[k].get(gram, 0) - discount[k], 0) / sum(seen) + discount[k] * len(seen) / sum(seen) * below

    def score(words):
        w = [K.START] * (order - 1) + words + [K.END]
        return sum(math.log(p(tuple(w[i - order + 1:i + 1]))) for i in range(order - 1, len(w))) / (len(words) + 1)
    return p, score, grams


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    subjects, verbs, things = ["the cat", "a dog", "my old friend"], ["sees", "likes", "eats"], ["the red ball", "a fish", "some bread"]
    out = [f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)} {rng.choice(['today', 'now', f'on day {i}'])}." for i in range(300)]
    return out + ["One", " ", "The Cat  sees", "the cat sees a fish now."]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_plain_counting(spark, prose, order):
    model = K.train(spark.createDataFrame([(s,) for s in [*prose, None]], "sentence string"), order=order)
    p, score, grams = kneser_ney([s for s in prose if s.strip()], order)
    for k in range(1, order + 1):
        got = {(*r.context.split(), r.word): r.c for r in model.grams[k].collect()}
        assert got == dict(grams[k])
        words = {g[-1] for g in grams[1]}
        context = next(g[:-1] for g in grams[k])
        assert sum(p((*context, w)) for w in words) == pytest.approx(1 - (p(("never seen",)) if order else 0), abs=0.05)
    tests = [["the", "cat", "sees", "a", "fish"], ["fish", "fish"], ["unknown", "words", "only"], ["the"] * 5]
    rows = spark.createDataFrame(list(enumerate(tests)), "id long, w array<string>")
    got = {r.id: r.score for r in K.scores(rows, model).collect()}
    for i, words in enumerate(tests):
        assert got[i] == pytest.approx(score(words), abs=1e-9)


def test_order_of_words_is_told_apart(spark, prose):
    rows = spark.createDataFrame([(s,) for s in prose] + [("bread now likes cat the a",), (None,)], "sentence string")
    got = {r.text: (r.label, r.score) for r in K.acceptability_scores(rows).collect()}
    assert set(got) == {s for s in prose if s.strip()} | {"bread now likes cat the a"}
    whole = [got[s][0] for s in prose[:300]]
    assert whole.count("acceptable") > 0.95 * len(whole) and got["bread now likes cat the a"][0] == "unacceptable"


def test_threshold_is_the_best_bucket(spark):
    rng = random.Random(2)
    good, bad = [rng.gauss(-2, 0.5) for _ in range(300)], [rng.gauss(-3, 0.6) for _ in range(280)]
    got = K.calibrate(*[spark.createDataFrame([(x,) for x in xs], "score double") for xs in (good, bad)])
    b = [math.floor(x * 100) for x in good], [math.floor(x * 100) for x in bad]
    right = {t: sum(x >= t for x in b[0]) + sum(x < t for x in b[1]) for t in set(b[0]) | set(b[1])}
    assert got == min(t for t in right if right[t] == max(right.values()))
    assert K.calibrate(spark.createDataFrame([], "score double"), spark.createDataFrame([], "score double")) == 0


# Latent vectors -----------------------------------------------------------------------------------------


def test_cosines_match_a_full_decomposition(spark):
    import numpy as np

    from paraforge.operators import embed as V

    rng = random.Random(11)
    topics = [[f"{name}{i}" for i in range(12)] for name in ("sea", "law", "art", "war")]
    texts = [" ".join(rng.choice(rng.choices(topics, [8, 1, 1, 1])[0] if t is None else topics[t]) for _ in range(rng.randrange(3, 15)))
             for t in [0, 1, 2, 3, None] * 25] + ["", " ", "alone", "sea0 sea0", "Sea0 sea0"]
    got = {r.text: np.array(r.vec) for r in V.latent_vectors(spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string"), 5, 12).collect()}
    assert set(got) == set(texts) and all(len(v) == 5 for v in got.values())
    names = sorted(set(texts))
    words = sorted({w for t in names for w in t.lower().split()})
    a = np.zeros((len(names), len(words)))
    for i, t in enumerate(names):
        for w in t.lower().split():
            a[i, words.index(w)] += 1
    a *= np.log((1 + len(names)) / (1 + (a > 0).sum(axis=0))) + 1
    length = np.sqrt((a * a).sum(axis=1, keepdims=True))
    a = np.divide(a, length, where=length > 0, out=np.zeros_like(a))
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want, have = (u * s)[:, :5], np.stack([got[t] for t in names])
    assert np.abs(have @ have.T - want @ want.T).max() < 1e-3
    assert not got[""].any() and not got[" "].any() and got["alone"].shape == (5,)


def test_more_dimensions_than_words(spark):
    from paraforge.operators import embed as V

    got = {r.text: r.vec for r in V.latent_vectors(spark.createDataFrame([("a b",), ("b",), ("",)], "text string"), 8).collect()}
    dot = sum(x * y for x, y in zip(got["a b"], got["b"]))
    assert len(got["b"]) == 8 and sum(x * x for x in got["a b"]) == pytest.approx(1, abs=1e-5) and 0 < dot < 1 and not any(got[""])
    assert V.latent_vectors(spark.createDataFrame([], "text string"), 4).count() == 0


def test_deletion_index_is_never_broadcast(spark, tmp_path):
    # A file of 30,000 words is small, its strings are not: the estimate of a Generate is that of its input.
    spark.range(30_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 9).alias("word"), F.lit(5).cast("long").alias("n")).write.parquet(
        str(tmp_path / "words"))
    vocabulary = spark.read.parquet(str(tmp_path / "words"))
    found = E.correction_candidates(spark.createDataFrame([("abcdef",)], "word string"), vocabulary)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_places_are_not_grouped_and_hold_one_context(spark, prose, monkeypatch):
    """The places of the words are written as they come, with their longest context only."""
    model = K.train(spark.createDataFrame([(s,) for s in prose], "sentence string"))
    written = {}
    real = K.write_once
    monkeypatch.setattr(K, "write_once", lambda df, name: written.update({name: df}) or real(df, name))
    rows = spark.createDataFrame([(1, ["the", "cat"] * 3)], "id long, w array<string>")
    assert K.scores(rows, model).count() == 1
    places = written["kn-places"]
    assert places.columns == ["id", "context3", "word"] and places.count() == 7
    assert "Aggregate" not in places._jdf.queryExecution().optimizedPlan().toString()


def test_a_place_is_shuffled_once_and_by_one_key(spark, prose, monkeypatch):
    """The joins with grams and sums of all orders lie in one stage, dealt by the context's last word."""
    model = K.train(spark.createDataFrame([(s,) for s in prose], "sentence string"))
    written = {}
    real = K.write_once
    monkeypatch.setattr(K, "write_once", lambda df, name: written.update({name: df}) or real(df, name))
    rows = spark.createDataFrame([(i, s.lower().split()) for i, s in enumerate(prose) if s.strip()], "id long, w array<string>")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None)
    assert K.scores(rows, model).count() == rows.count()
    plan = written["kn-scores"]._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*), \d+\)", plan)}
    assert keys and keys <= {"key", "word", "id"}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", None) == before


def test_longer_grams_and_a_mark_in_the_text(spark):
    texts = ["a b c d e", "a b c d f", "x b c d e", "<s> b c d </s>", "b c <s> a", "a", "c d e a b", "a b c d e", "é \u3000 b\u00a0c"]
    model = K.train(spark.createDataFrame([(s,) for s in texts], "sentence string"), order=5)
    _, score, grams = kneser_ney(texts, 5)
    for k in range(1, 6):
        assert {(*r.context.split(), r.word): r.c for r in model.grams[k].collect()} == dict(grams[k])
    tests = [t.lower().split() for t in texts] + [["d", "c", "b"], ["q"], ["<s>", "<s>", "a"]]
    got = {r.id: r.score for r in K.scores(spark.createDataFrame(list(enumerate(tests)), "id long, w array<string>"), model).collect()}
    for i, words in enumerate(tests):
        assert got[i] == pytest.approx(score(words), abs=1e-9)


def test_scores_without_a_trained_sentence(spark):
    model = K.train(spark.createDataFrame([], "sentence string"))
    got = K.scores(spark.createDataFrame([(1, ["a", "b"])], "id long, w array<string>"), model).collect()
    assert [(r.id, r.score) for r in got] == [(1, 0.0)]


def test_vectors_do_not_depend_on_blocks_and_files(spark, monkeypatch, tmp_path):
    import numpy as np

    from paraforge.operators import embed as V

    rng = random.Random(4)
    texts = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(0, 12))) for _ in range(120)] + ["w1 " * 50, "own words"]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)

    def cosines(vectors):
        x = np.array([vectors[t] for t in sorted(vectors) if t.strip()])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return x @ x.T

    whole = {r.text: r.vec for r in V.latent_vectors(table, 6).collect()}
    monkeypatch.setattr(V, "BLOCK_WORDS", 25)
    monkeypatch.setattr(V, "FILE_WORDS", 7)
    monkeypatch.setattr(V, "HELD_WORDS", 12)
    parts = {r.text: r.vec for r in V.latent_vectors(table, 6).collect()}
    assert set(whole) == set(parts) == set(texts) and np.abs(cosines(whole) - cosines(parts)).max() < 1e-5


def test_a_round_returns_a_row_for_each_word_of_a_task(spark, monkeypatch, tmp_path):
    """Not one for each word of each text; files of earlier rounds are not kept."""
    import numpy as np

    from paraforge.operators import embed as V

    texts = [f"all of these words come in each text t{i}" for i in range(50)]
    monkeypatch.setattr(V, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    words, matrix = V.term_matrix(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert words.count() == 58 and sum(len(r.texts) for r in matrix.select("texts").collect()) == 50
    files, turn = V.principal_words(words, matrix, 4, 2)
    assert len(files) == 1 and [str(f) for f in tmp_path.glob("*/words-00000000-*")] == files
    rows = V._there_and_back(matrix.coalesce(1), files, turn).collect()
    assert sorted(r.number for r in rows) == [*range(-4, 58)]
    block = np.fromfile(files[0]).reshape(58, 4) @ turn
    assert np.abs(block.T @ block - np.eye(4)).max() < 1e-9


def test_sums_of_segments_in_pieces(monkeypatch):
    import numpy as np

    from paraforge.operators import embed as V

    rng = np.random.default_rng(3)
    edge = np.array([0, 0, 5, 5, 6, 19, 20, 20])
    weight, index, source = rng.random(20), rng.integers(0, 9, 20), rng.random((9, 3))
    want = np.stack([(weight[a:z, None] * source[index[a:z]]).sum(axis=0) for a, z in zip(edge[:-1], edge[1:])])
    for at_once in (1, 2, 7, 100):
        monkeypatch.setattr(V, "AT_ONCE", at_once)
        assert np.abs(V._sums(edge, weight, index, source) - want).max() < 1e-12
