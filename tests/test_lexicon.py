from pyspark.sql import functions as F

from paraforge.operators import lexicon as LX
from paraforge.sources import fixtures as X


def test_contextual_synonyms_ranking(spark):
    reqs = spark.createDataFrame([("r1", "I am very happy today", "happy"), ("r2", "Nothing matches", "zzz"),
                                  ("r3", "so glad", "absentword")], "request_id string, text string, word string")
    ws = spark.createDataFrame([("happy", "s1"), ("absentword", "s2")], "word string, synset_id string")
    sl = spark.createDataFrame([("s1", "glad", 5, 0), ("s1", "Happy", 3, 1), ("s1", "felicitous", 1, 2),
                                ("s1", "well_chosen", 1, 3), ("s1", "content", 2, 4), ("s1", "cheerful", 2, 5),
                                ("s1", "merry", 1, 6), ("s1", "jolly", 1, 7), ("s2", "x", 1, 8)],
                               "synset_id string, lemma string, lemma_count long, ord long")

    def predictor(masked):
        rows = [("r1", t, s) for t, s in [("glad", 0.5), ("cheerful", 0.2), ("content", 0.2), ("merry", 0.1),
                                          ("jolly", 0.05), ("felicitous", 0.0)]]
        return spark.createDataFrame(rows, "request_id string, token string, score double") \
                    .join(masked.select("request_id"), "request_id", "left_semi")

    out = {r.request_id: list(r.synonyms) for r in LX.contextual_synonyms(reqs, ws, sl, predictor).collect()}
    assert out["r1"] == ["glad", "cheerful", "content", "merry", "jolly"]   # tie -> alphabetical, cut at 5
    assert out["r2"] == [] and out["r3"] == []                            # no lexicon entry / word absent


def test_synonym_frequency_topk(spark):
    words = spark.createDataFrame([("quick",)], "word string")
    ws = spark.createDataFrame([("quick", "a"), ("quick", "b")], "word string, synset_id string")
    sl = spark.createDataFrame([("a", "fast", 3, 0), ("a", "quick", 9, 1), ("b", "fast", 2, 2), ("b", "speedy", 5, 3),
                                ("b", "agile", 5, 4), ("b", "Quick", 1, 5)],
                               "synset_id string, lemma string, lemma_count long, ord long")
    top = LX.topk_synonyms(LX.synonym_frequency(words, ws, sl), k=8)
    got = [(r.name, r.freq) for r in top.orderBy("rank").collect()]
    assert got == [("fast", 5), ("speedy", 5), ("agile", 5)]   # ties keep first-seen order


def test_fold_predictions_last_wins(spark):
    preds = spark.createDataFrame([("r", " Glad", 0.6), ("r", "glad ", 0.3), ("r", "x", 0.1)],
                                  "request_id string, token string, score double")
    got = {r.token: r.score for r in LX.fold_predictions(preds).collect()}
    assert got == {"glad": 0.3, "x": 0.1}


def test_predict_masked_hook_folds_and_cuts(spark):
    from paraforge.operators import infer as H

    def factory():
        def fn(pdf):
            import pandas as pd
            rows = []
            for m in pdf["masked"]:
                rows += [(m, " Glad", 0.5), (m, "glad ", 0.2), (m, "HAPPY", 0.4)] + [(m, f"t{i}", 0.001 * i) for i in range(150)]
            return pd.DataFrame(rows, columns=["masked", "token", "score"])
        return fn

    masked = spark.createDataFrame([("r1", "I am [MASK] now"), ("r2", "I am [MASK] now")], "request_id string, masked string")
    out = H.predict_masked(masked, factory, k=100).collect()
    by = {}
    for r in out:
        by.setdefault(r.request_id, {})[r.token] = r.score
    assert set(by) == {"r1", "r2"}
    assert by["r1"]["glad"] == 0.2 and by["r1"]["happy"] == 0.4   # folded; the later-ranked duplicate wins
    assert len(by["r1"]) == 99                   # the best 100 are cut first, and two of them fold into one


ENTRIES = {("happy", "a"): ["h1"], ("big", "a"): ["b1"], ("box", "n"): ["x1"], ("box", "v"): ["x2"], ("boxing", "n"): ["x3"], ("wolf", "n"): ["w1"],
           ("man", "n"): ["m1"], ("berry", "n"): ["f1"], ("bake", "v"): ["k1"], ("run", "v"): ["r1"], ("running", "n"): ["r2"], ("ice_cream", "n"): ["i1"],
           ("good", "a"): ["g1"], ("well", "r"): ["g2"], ("better", "v"): ["g3"], ("fine", "a"): ["fi"], ("finer", "n"): ["fn"], ("s", "n"): ["ss"],
           ("bus", "n"): ["u1"], ("axe", "n"): ["a1"], ("ax", "n"): ["a1"], ("go", "v"): ["go"], ("happier", "n"): ["h9"]}
EXCEPTED = [("a", "better", "good"), ("r", "better", "well"), ("v", "went", "go"), ("n", "geese", "goose"), ("a", "Happier", "happy")]
LOOKED_UP = ["happy", "Happier", "happiest", "bigger", "boxes", "Boxing", "boxings", "wolves", "men", "berries", "bakes", "baked", "baking", "runs",
             "running", "runnings", "ice cream", "Ice creams", "better", "went", "geese", "finer", "finest", "s", "ss", "buses", "axes", "goes", "xyz", "",
             "boxingss", "finers"]


def plain_senses(word):
    """The lookup by loops over words, endings and parts of speech."""
    key, out = word.lower().replace(" ", "_"), []
    for pos, rules in LX.DETACHMENTS.items():
        bases = [b for p, f, b in EXCEPTED if p == pos and f.lower() == key]
        if bases:
            steps = [[key, *bases]]
        else:
            steps, now = [], [key]
            for depth in range(LX.DETACH_DEPTH):
                then = [w[:len(w) - len(old)] + new for w in now for old, new in rules if w.endswith(old)]
                steps.append([key, *then] if depth == 0 else then)
                now = then
        for forms in steps:
            found = {(f, s) for f in forms for s in ENTRIES.get((f, pos), [])}
            if found:
                out += sorted(found)
                break
    return out


def lexicon_tables(spark):
    ws = spark.createDataFrame([(w, p, s) for (w, p), ss in ENTRIES.items() for s in ss], "word string, pos string, synset_id string")
    return ws, spark.createDataFrame(EXCEPTED, "pos string, form string, base string")


def test_base_forms_match_plain_lookup(spark):
    ws, exc = lexicon_tables(spark)
    words = spark.createDataFrame([(w,) for w in LOOKED_UP] + [(None,)], "word string")
    got = {}
    for r in LX.word_senses(words, ws, exc).collect():
        got.setdefault(r.lword, []).append((r.form, r.synset_id))
    assert {w: sorted(v) for w, v in got.items()} == {w.lower(): sorted(plain_senses(w)) for w in LOOKED_UP if plain_senses(w)}
    assert got["happier"] and got["ice creams"] == [("ice_cream", "i1")] and ("box", "x2") in got["boxings"]
    # without parts of speech all endings apply, without exceptions nothing stops them
    flat = {r.lword for r in LX.word_senses(words, ws.drop("pos")).collect()}
    assert {"wolves", "boxes", "finest", "baking"} <= flat and "went" not in flat


def test_known_forms_invert_the_lookup(spark):
    ws, exc = lexicon_tables(spark)
    lemmas = spark.createDataFrame([(s, f"name-{s}", 1, 0) for ss in ENTRIES.values() for s in ss] + [("h1", "two_words", 1, 0)],
                                   "synset_id string, lemma string, lemma_count long, ord long")
    got = {r.key: set(r.candidates) for r in LX.known_forms(ws, lemmas, exc).collect()}
    for w in LOOKED_UP:
        want = {f"name-{s}" for _, s in plain_senses(w)}
        assert got.get(w.lower().replace(" ", "_"), set()) == want, w


def test_synonym_stream_equals_batch(spark):
    from paraforge.streaming import requests as ST

    ws, exc = lexicon_tables(spark)
    lemmas = spark.createDataFrame([("h1", "glad", 1, 0), ("h1", "merry", 2, 1), ("h1", "happy", 3, 2), ("x1", "case", 1, 3), ("x2", "fight", 1, 4),
                                    ("b1", "large", 1, 5)] + [("w1", f"t{i}", 1, 6) for i in range(9)],
                                   "synset_id string, lemma string, lemma_count long, ord long")
    bigrams = spark.createDataFrame([("so", "merry", 0.5), ("so", "glad", 0.5), ("so", "happy", 0.2), ("the", "case", 0.1), ("the", "fight", 0.3),
                                     ("the", "large", 0.0)] + [("two", f"t{i}", 0.1 * (i % 3) + 0.1) for i in range(9)],
                                    "prev string, token string, score double")
    rows = [("1", "I am so happier now", "happier"), ("2", "the boxes", "Boxes"), ("3", "the big one", "big"), ("4", "two wolves", "wolves"),
            ("5", "nothing", "absent"), ("6", "word is not in it", "boxes"), ("7", "boxes", "boxes"), ("8", None, "boxes"), ("9", "so happy", None),
            ("10", "so happy", "happy"), ("10b", "so happy", "happy")]
    reqs = spark.createDataFrame(rows, "request_id string, text string, word string")
    batch = LX.contextual_synonyms(reqs, ws, lemmas, LX.bigram_predictor(bigrams), exceptions=exc)
    forms, predictions = LX.known_forms(ws, lemmas, exc), LX.ranked_predictions(bigrams)
    stream = ST.request_stream(spark, ST.stage_requests(reqs), "request_id string, text string, word string", 1)
    out = ST.run_stream(spark, stream, lambda s: LX.contextual_synonyms_stream(s, forms, predictions), name="syn-test")
    got = {(r.request_id, r.word, tuple(r.synonyms)) for r in spark.read.parquet(out).collect()}
    assert got == {(r.request_id, r.word, tuple(r.synonyms)) for r in batch.collect()} and len(got) == len(rows)
    by = {i: s for i, _, s in got}
    assert by["1"] == ("glad", "merry", "happy") and by["10"] == ("glad", "merry") and by["2"] == ("fight", "case") and by["4"] == ("t2", "t5", "t8", "t1", "t4") and by["3"] == ()


def test_candidates_and_frequency_against_plain_loops(spark, monkeypatch):
    """Names of several synsets, two forms that share one, repeated rows, several words a key; in blocks of a few rows."""
    from collections import defaultdict

    senses = [("run", "s1"), ("run", "s2"), ("run", "s2"), ("runs", "s3"), ("go", "s1"), ("go", "s3"), ("lone", "s9")]
    lemmas = [("s1", "Run", 3, 0), ("s1", "race", 2, 1), ("s2", "race", 5, 2), ("s2", "race", 1, 3), ("s2", "Race", 1, 4), ("s3", "race_on", 4, 5),
              ("s3", "go", None, 6), ("s3", "move", None, 7)] + [("s1", f"w{i}", i, 10 + i) for i in range(40)] + [("s3", f"w{i}", 1, 60 + i) for i in range(20)]
    asked = [("a", "run"), ("a", "go"), ("b", "Run"), ("b", "run"), ("c", "RUNS"), ("d", "none"), ("e", None), (None, "run"), (None, "go")]
    ws = spark.createDataFrame(senses, "word string, synset_id string")
    sl = spark.createDataFrame(lemmas, "synset_id string, lemma string, lemma_count long, ord long")
    reqs = spark.createDataFrame(asked, "request_id string, word string")
    found = defaultdict(list)
    for r in LX.word_senses(reqs, ws).collect():
        found[r.lword].append(r.synset_id)
    pairs, freq = set(), defaultdict(list)
    for k, w in asked:
        for s in found.get((w or "").lower(), []):
            pairs |= {(k, name.lower()) for t, name, _, _ in lemmas if t == s and "_" not in name and name.lower() != w.lower()}
    for w in {w for _, w in asked if w}:
        for s in found.get(w.lower(), []):
            for t, name, n, o in lemmas:
                if t == s and name.replace("_", " ").lower() != w.lower():
                    freq[w, name.replace("_", " ")].append((n, o))
    want = {(w, name): (sum(n for n, _ in v if n is not None) if any(n is not None for n, _ in v) else None, min(o for _, o in v)) for (w, name), v in freq.items()}
    for size in (LX.WORD_BLOCK, 2):
        monkeypatch.setattr(LX, "WORD_BLOCK", size)
        monkeypatch.setattr(LX, "NAME_BLOCK", size)
        got = [tuple(r) for r in LX.lexicon_candidates(reqs, ws, sl).collect()]
        assert set(got) == pairs and len(got) == len(pairs)
        rows = LX.synonym_frequency(reqs, ws, sl).collect()
        assert {(r.word, r.name): (r.freq, r.first_ord) for r in rows} == want and len(rows) == len(want)
        words = LX.word_candidates(reqs, ws, sl)
        assert words.count() == words.distinct().count() and {(r.lword, r.candidate) for r in words.collect()} == {
            (w.lower(), c) for k, w in asked if w for kk, c in pairs if (kk, w) == (k, w) and any(
                t in found[w.lower()] and n.lower() == c and "_" not in n and c != w.lower() for t, n, _, _ in lemmas)}
    # no shuffle of the pairs themselves: nothing is grouped after words and names have met
    plan = LX.word_candidates(reqs, ws, sl)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("SortMergeJoin") < len(plan) and "HashAggregate" not in plan[:plan.index("SortMergeJoin")]


def test_scores_are_found_in_the_row(spark):
    """Keys of one request and keys of several against the joins of pairs; no pair of request and candidate or prediction is shuffled."""
    ws = spark.createDataFrame([("happy", "s1"), ("happy", "s2"), ("box", "s3"), ("big", "s2")], "word string, synset_id string")
    sl = spark.createDataFrame([("s1", "glad", 1, 0), ("s1", "Merry", 1, 1), ("s2", "merry", 1, 2), ("s2", "large", 1, 3), ("s2", "very_big", 1, 4),
                                ("s3", "case", 1, 5), ("s1", "happy", 1, 6), (None, "lost", 1, 7)], "synset_id string, lemma string, lemma_count long, ord long")
    bigrams = spark.createDataFrame([("so", "merry", 0.5), ("so", "glad", 0.25), ("so", "happy", 0.25), ("the", "case", 0.4), ("the", "large", 0.0),
                                     ("a", "large", 1.0)], "prev string, token string, score double")
    rows = [("1", "I am so happy now", "happy"), ("2", "the boxes", "Boxes"), ("3", "a big one", "big"), ("4", "happy", "happy"), ("5", "so sad", "absent"),
            ("6", None, "box"), (None, "so happy", "happy"), ("7", "no such word", "box"), ("8", "so happy", "happy"), ("8", "a big box", "big"), ("8", "a big box", "big")]
    reqs = spark.createDataFrame(rows, "request_id string, text string, word string")
    predictor = LX.bigram_predictor(bigrams)
    plain = lambda masked: predictor(masked)  # noqa: E731  one row a prediction
    for positive in (False, True):
        got = sorted(tuple(r) for r in LX.score_lookup(reqs, ws, sl, predictor, positive=positive).collect())
        assert got == sorted(tuple(r) for r in LX.score_lookup(reqs, ws, sl, plain, positive=positive).collect()) and len(got) > 4
        assert all(r[2] > 0 for r in got) or not positive
    lists = [sorted((r.request_id or "", r.word, tuple(r.synonyms)) for r in LX.contextual_synonyms(reqs, ws, sl, p).collect()) for p in (predictor, plain)]
    assert lists[0] == lists[1] and len(lists[0]) == len(rows) and ("1", "happy", ("merry", "glad")) in lists[0]
    own = reqs.filter("request_id < '8'")
    plan = LX.score_lookup(own, ws, sl, predictor)._jdf.queryExecution().optimizedPlan().toString()
    assert "candidate" not in plan[plan.index("Join"):]


def test_score_lookup_works_out_its_lists_once(spark):
    """Names shared by several synsets of a word come once with their score; what the synsets' sizes and the pairs both read is written:
    neither predictions nor senses are worked out again for the pairs."""
    ws = [("run", s) for s in ("s1", "s2", "s3")] + [("jog", "s2"), ("race", "s3"), ("race", "s1")]
    sl = [("s1", "dash"), ("s2", "dash"), ("s3", "Dash"), ("s2", "trot"), ("s3", "trot"), ("s3", "sprint"), ("s0", "sprint"), ("s1", "run"),
          ("s2", "long_run"), ("s0", "rest")]
    bigrams = [("we", "trot", 0.5), ("we", "dash", 0.25), ("we", "rest", 0.25), ("they", "sprint", 1.0)]
    rows = [("1", "we run", "run"), ("2", "they race", "Race"), ("3", "we jog", "jog"), ("4", "we walk", "walk")]
    expected = []
    for key, text, word in rows:
        mine = {s for w, s in ws if w == word.lower()}
        few = {t: x for p, t, x in bigrams if p == text.split()[0]}
        expected += [(key, n, few.get(n, 0.0)) for n in {lemma.lower() for s, lemma in sl if s in mine and "_" not in lemma} - {word.lower()}]
    table = spark.createDataFrame([(s, lemma, 1, i) for i, (s, lemma) in enumerate(sl)], "synset_id string, lemma string, lemma_count long, ord long")
    out = LX.score_lookup(spark.createDataFrame(rows, "request_id string, text string, word string"), spark.createDataFrame(ws, "word string, synset_id string"),
                          table, LX.bigram_predictor(spark.createDataFrame(bigrams, "prev string, token string, score double")))
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected) and len(expected) == 9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LogicalRDD" not in plan and "collect_set" not in plan


def test_a_pair_of_request_and_candidate_needs_no_lambda(spark):
    """The expansion is one generated loop; names and words with none, one or several synsets before the one they meet in come once."""
    ws = [("a", f"s{i}") for i in range(4)] + [("b", "s3"), ("b", "s1"), ("c", "s2")]
    names = {"one": [3], "two": [1, 3], "three": [0, 2, 3], "four": [0, 1, 2, 3], "five": [1, 2]}
    table = [(f"s{i}", n, 1, 0) for n, homes in names.items() for i in homes]
    bigrams = [("x", "two", 0.5), ("x", "four", 0.25), ("x", "one", 0.25)]
    rows = [(f"{w}{left}", f"{left} {w}", w) for w in "abc" for left in "xy"]
    predictor = LX.bigram_predictor(spark.createDataFrame(bigrams, "prev string, token string, score double"))
    out = LX.score_lookup(spark.createDataFrame(rows, "request_id string, text string, word string"), spark.createDataFrame(ws, "word string, synset_id string"),
                          spark.createDataFrame(table, "synset_id string, lemma string, lemma_count long, ord long"), predictor)
    expected = []
    for key, text, word in rows:
        mine = {s for w, s in ws if w == word}
        few = {t: x for p, t, x in bigrams if p == text[0]}
        expected += [(key, n, few.get(n, 0.0)) for n, homes in names.items() if mine & {f"s{i}" for i in homes}]
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
    pairs = out._jdf.queryExecution().optimizedPlan().toString().split("\n")[:2]  # the scores and the join, with its condition
    assert "Project" in pairs[0] and "Join" in pairs[1] and "lambda" not in "".join(pairs)


def test_senses_meet_the_lexicon_once(spark):
    words = spark.createDataFrame([("boxes",), ("Box",), (None,)], "word string")
    ws = spark.createDataFrame([("box", "n", "s1"), ("boxes", "n", "s2"), ("boxe", "n", "s3")], "word string, pos string, synset_id string")
    out = LX.word_senses(words, ws)
    assert {tuple(r) for r in out.collect()} == {("boxes", "box", "s1"), ("boxes", "boxes", "s2"), ("boxes", "boxe", "s3"), ("box", "box", "s1")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # forms with entries, and keys with words


def test_lexicon_tables_are_derived_from_one_count(spark, tmp_path):
    rows = [(1, 0, "user", "The plants grow. They grow fast."), (1, 1, "assistant", "Plants need water."), (1, 1, "assistant", "Yes."),
            (None, 0, "user", "Never seen."), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    X.reset_memo()
    try:
        ws, sl = X.word_synsets(spark, str(tmp_path)), X.synset_lemmas(spark, str(tmp_path), with_ord=False)
        assert ("plants", "n", "p:plant") in {tuple(r) for r in ws.collect()}
        assert {(r.synset_id, r.lemma, r.lemma_count) for r in sl.collect()} >= {("p:plant", "plants", 3), ("s:lants", "plants", 3), ("p:grow", "grow", 2)}
        for table in (ws, sl):
            plan = table._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in plan and "Join" not in plan
    finally:
        X.reset_memo()


def test_forms_hold_synsets_not_lemmas(spark):
    """A form's row does not grow with the lemmas of its synsets."""
    ws = spark.createDataFrame([(f"word{i}", "s") for i in range(50)], "word string, synset_id string")
    assert {tuple(r.senses) for r in LX.form_senses(ws).collect()} == {("s",)}
    lemmas = spark.createDataFrame([("s", f"word{i}", 1, 0) for i in range(50)], "synset_id string, lemma string, lemma_count long, ord long")
    assert {r.key for r in LX.form_senses(ws).collect()} == {r.key for r in LX.known_forms(ws, lemmas).collect()}
