import ast
import json
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paraforge.functions import text as T

# text -> expected sentences, written by hand
SPLITS = {
    "Dr. Smith arrived. He sat down.": ["Dr. Smith arrived.", "He sat down."],
    "The U.S. The end.": ["The U.S. The end."],
    "It ended. then it went on.": ["It ended. then it went on."],
    "Il est venu. \u00c9t\u00e9 chaud.": ["Il est venu. \u00c9t\u00e9 chaud."],
    "Line one.\nLine two! Really? Yes": ["Line one.", "Line two!", "Really?", "Yes"],
    "Keep a <PERIOD> here. Next one.": ["Keep a . here.", "Next one."],
    "": [],
    "   \n  ": [],
    "Prices rose etc. The market fell. Mr. and Mrs. Jones left.": ["Prices rose etc. The market fell.", "Mr. and Mrs. Jones left."],
    "Wait...   What?  No!": ["Wait...", "What?", "No!"],
    "One.\x1cTwo.": ["One.", "Two."],
}


def test_split_sentences(spark):
    df = spark.createDataFrame([(t,) for t in SPLITS], "t string")
    for r in df.select("t", T.split_sentences("t").alias("s")).collect():
        assert r.s == SPLITS[r.t], r.t


# (a, b) -> expected overlap
OVERLAPS = {
    ("", "some text"): 0.0, ("same words", "same words"): 1.0, ("Case Only", "case only"): 1.0, ("job.", "job"): 0.0,
    ("a a a b", "a b b"): 1.0, ("  leading spaces", "leading spaces"): 1.0, ("no\u00a0break", "no break"): 1.0,
    ("the cat sat", "the dog sat"): 0.5, ("a\x1cb", "a b"): 1.0, ("a b c d", "d e"): 0.2,
}


def test_word_overlap(spark):
    df = spark.createDataFrame(list(OVERLAPS), "a string, b string")
    for r in df.select("a", "b", T.word_overlap("a", "b").alias("o")).collect():
        assert r.o == OVERLAPS[(r.a, r.b)], r


def test_overlap_symmetric_and_bounded(spark):
    from hypothesis import given, settings, strategies as st
    words = st.lists(st.sampled_from(["a", "b", "C", "d.", "é", "x1"]), max_size=6).map(" ".join)

    rows = []

    @settings(max_examples=60, deadline=None)
    @given(words, words)
    def collect(a, b):
        rows.append((a, b))

    collect()
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select("a", "b", T.word_overlap("a", "b").alias("ab"), T.word_overlap("b", "a").alias("ba")).collect()
    for r in out:
        assert r.ab == r.ba and 0.0 <= r.ab <= 1.0
        same = sorted(set(r.a.lower().split())) == sorted(set(r.b.lower().split()))
        assert (r.ab == 1.0) == (same and r.a != "")


# (original, candidate) -> names and numbers of the candidate, and whether it brings new ones
ENTITIES = {
    ("Paris is big.", "Big is Paris."): ({"paris"}, set(), True),
    ("I met Anna.", "I met Bob."): ({"bob"}, set(), True),
    ("It costs 12 dollars.", "It costs 13 dollars."): (set(), {"13"}, True),
    ("I like tea.", "Tea is what I like."): ({"i"}, set(), True),
    ("We saw \u00c9mile.", "We saw \u00e9mile."): (set(), set(), False),
    ("Hello ... world", "Hello !!! world"): (set(), set(), False),
    ("On 3 May we left.", "We left on 3 (May)."): ({"may"}, {"3"}, False),
}


def test_entities(spark):
    df = spark.createDataFrame(list(ENTITIES), "o string, c string")
    out = df.select("o", "c", T.proper_nouns("c").alias("pn"), T.numbers("c").alias("num"),
                    T.introduces_new_entities("o", "c").alias("new")).collect()
    for r in out:
        assert (set(r.pn), set(r.num), r.new) == ENTITIES[(r.o, r.c)], r


# (sentence, word) -> expected
MASKS = {
    ("the word and the word", "word"): "the [MASK] and the word", ("The Word here", "word"): "The [MASK] here",
    ("swordfish word", "word"): "swordfish [MASK]", ("a+b is a+b", "a+b"): "[MASK] is a+b",
    ("nothing here", "absent"): "nothing here", ("\u00c9t\u00e9 chaud, \u00e9t\u00e9", "\u00e9t\u00e9"): "[MASK] chaud, \u00e9t\u00e9",
}


def test_mask_word_first_match_only(spark):
    df = spark.createDataFrame(list(MASKS), "s string, w string")
    for r in df.select("s", "w", T.mask_word(F.col("s"), F.col("w")).alias("m")).collect():
        assert r.m == MASKS[(r.s, r.w)]


# list literal -> expected items (None: not a list literal)
LITERALS = {
    "['one', 'two']": ["one", "two"], """["it's", 'b']""": ["it's", "b"], r"['don\'t']": ["don't"], r"['a\xa0b']": ["a\u00a0b"],
    "[]": [], r"['a\\x41']": [r"a\x41"], "['a', 'b',]": ["a", "b"], "('a', 'b')": ["a", "b"], "not a list": None,
}


def test_parse_paraphrase_list(spark):
    df = spark.createDataFrame([(r,) for r in LITERALS], "s string")
    for r in df.select("s", T.parse_paraphrase_list("s").alias("a")).collect():
        assert r.a == LITERALS[r.s], r.s
    df = spark.createDataFrame([("['x']",), ("[]",)], "s string")
    first = [r.f for r in df.select(T.first_paraphrase(T.parse_paraphrase_list("s")).alias("f")).collect()]
    assert first[-1] is None


def test_blank_guard_and_prefix(spark):
    df = spark.createDataFrame([("",), ("  \n",), (None,), ("x",)], "t string")
    got = [r.b for r in df.select(T.is_blank("t").alias("b")).collect()]
    assert got == [True, True, True, False]
    assert df.select(T.prompt_prefix(F.lit("x")).alias("p")).first().p == "paraphrase: x"


def test_list_literal_round_trip(spark):
    arr = ['say "hi"', "back\\slash", "two\nlines"]
    df = spark.createDataFrame([(arr,)], "a array<string>")
    lit = df.select(T.list_literal("a").alias("l"))
    assert lit.select(T.parse_paraphrase_list("l").alias("p")).first().p == arr


PIECES = st.one_of(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\0"), max_size=8), st.integers(-10 ** 6, 10 ** 6), st.none(),
                   st.sampled_from(["it's", 'say "x"', "a\\b", "tab\t", "é", "\U0001f600", "a/b", "line\nbreak", "\x07"]))
SPELLINGS = [r"['\x41\102', 'b']", r"['\N{BULLET}']", "['a' 'b', \"c\" 'd']", "['''x''', \"\"\"y\"z\"\"\"]", "(1, 2.50, None)", "[1e3, -4, 1_000]", "['a',]", "('a',)", "()", "[]",
             r"['\d', 'a\/b']", r"['😀', 'é']", "[u'a', r'\\n']", "['a\tb']", " ['lead']", r"['\0', '\a']", "[true]", "[null, 'a']", "['a', ['b']]", "{'a'}", "'a'",
             "['a'] x", "[", "", "['a' , 'b' ]", r"['\\x41', '\x41']", "[b'a']", "[True, None]", "['open]"]


def literal(text):
    """What the language's own parser reads, as lists of strings."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError):
        return None
    if not isinstance(value, (list, tuple)) or any(isinstance(x, (list, tuple, dict, set, bytes)) for x in value):
        return None
    return [None if x is None else str(x).encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in value]


def test_list_literals_read_like_the_language(spark):
    found = []

    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.lists(PIECES, max_size=4), st.sampled_from([repr, lambda x: repr(tuple(x)), json.dumps]))
    def collect(items, render):
        if render is json.dumps and (None in items or any("\x7f" in x for x in items if isinstance(x, str))):
            return
        found.append(render(items))
    collect()
    rows = sorted(set(found + SPELLINGS))
    df = spark.createDataFrame([(s,) for s in rows] + [(None,)], "s string")
    got = {r.s: (None if r.a is None else list(r.a)) for r in df.select("s", T.parse_paraphrase_list("s").alias("a")).collect()}
    assert got.pop(None) is None
    assert got == {s: literal(s) for s in rows}
    assert len(rows) > 150 and sum(v is not None for v in got.values()) > 120


def test_document_entities_found_once_per_sentence(spark, tmp_path):
    from paraforge.sources import fixtures as X

    text = "We met Anna in 2001. Then Bob came. Now Anna and Bob left 7 cats. It is late."
    spark.createDataFrame([(1, text, "en", "web", len(text)), (2, None, None, None, None)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    X.reset_memo()
    rows = X.document_entities(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # not for each pair
    found = rows.select("sentence_id", "gen_idx", T.new_entities_from("text_nouns", "original_nouns", "text_numbers", "original_numbers").alias("new"))
    want = X.candidates(spark, str(tmp_path), "documents").select("sentence_id", "gen_idx", T.introduces_new_entities("original", "text").alias("new"))
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() == 6
