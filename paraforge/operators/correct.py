"""H3 default: spelling corrections by a deletion-neighbourhood index and a best path along the sentence.

1. *Vocabulary*: cleaned words with at least ``MIN_COUNT`` occurrences. A word of a text that is in it stays.
2. *Candidates* of the other words: a word within edit distance d of a vocabulary word shares a string with it that d deletions
   in each leave over. Both sides are exploded to these strings and met in an equi-join on them; the exact distance is verified
   on the pairs (two swapped neighbours are one edit), and the ``CANDIDATES`` best by (distance, frequency, word) remain. Words of up to ``SHORT`` letters may
   differ by one edit, longer ones by two; words of one or two letters are left alone.
3. *Path*: each unknown word is kept or replaced by a candidate. A choice costs its log-frequency (an unknown word counts as half an
   occurrence), ``EDIT_COST`` an edit, and the bigram log-probability with both neighbours. The cheapest path of a text is found in an
   Arrow pass over its own choices (dynamic programming, work linear in its length).

Log-probabilities are whole millionths, ties go to the earlier choice (the word itself, then candidates in order), so reruns agree.
White space is collapsed, a full stop added where no mark ends the text, and a replacement takes the case of its word.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraforge.functions import text as T
from paraforge.session import write_once

MIN_COUNT = 3
SHORT = 4
CANDIDATES = 5
EDIT_COST = 1.5
FLOOR = 0.001
UNIT = 1_000_000
# A word that may be corrected: letters with other characters around them.
SHAPE = r"(?U)^([^\p{L}]*)(\p{L}+)([^\p{L}]*)\z"


def core(word) -> F.Column:
    """The lower-cased letters of a word, '' where something else stands between them."""
    return F.lower(F.regexp_extract(word, SHAPE, 2))


def _edits(word) -> F.Column:
    return F.when(F.length(word) <= SHORT, 1).otherwise(2)


def _without_one(forms: F.Column) -> F.Column:
    """Every string that one deletion in one of the strings leaves over."""
    def each(w):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(
            F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(forms, each)))


def deletions(words: DataFrame, word: str, edits: F.Column) -> DataFrame:
    """(..., left): each word with every string that up to ``edits`` (1 or 2) deletions leave over."""
    rows = words.withColumn("_one", F.explode(F.array(_without_one(F.array(word)))))
    rows = rows.withColumn("_two", F.when(edits > 1, _without_one(F.col("_one"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("left", F.explode(F.array_distinct(F.concat(F.array(word), "_one", "_two")))).drop("_one", "_two")


def edit_distance(a: str, b: str) -> F.Column:
    """The edit distance of two columns up to 2, else -1; one swap of neighbouring letters is one edit."""
    plain = F.levenshtein(a, b, 2)
    swaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(
        F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))))
    return F.when((plain == 2) & (F.length(a) == F.length(b)) & F.array_contains(swaps, F.col(b)), 1).otherwise(plain)


def known_words(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the vocabulary."""
    return counts.filter(F.col("n") >= min_count).select("word", "n")


def correction_candidates(unknown: DataFrame, vocabulary: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(word, candidate, distance, n, rank): the best vocabulary words near each unknown word (column ``word``)."""
    todo = unknown.filter(F.length("word") > 2)
    near = deletions(todo, "word", _edits(F.col("word"))).select("word", "left")
    index = deletions(vocabulary.select(F.col("word").alias("candidate"), "n"), "candidate", F.lit(2)).select("candidate", "n", "left")
    # Both sides grow by the strings of a word, which the size estimate does not see: neither may be broadcast.
    pairs = near.join(index.hint("merge"), "left").select("word", "candidate", "n").distinct()
    pairs = pairs.withColumn("distance", F.explode(F.array(edit_distance("word", "candidate")))).filter(
        (F.col("distance") >= 1) & (F.col("distance") <= _edits(F.col("word"))))
    best = Window.partitionBy("word").orderBy("distance", F.desc("n"), "candidate")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_path(choices: list[list[tuple[int, int]]], joint) -> list[int]:
    """The choice at each place with the greatest sum of scores; ``choices[i]`` is (choice, score), ``joint(i, a, b)`` the score of b at
    place i after a. Ties go to the earlier choice."""
    best = {b: (score, None) for b, score in choices[0]}
    trail = [best]
    for i in range(1, len(choices)):
        now = {}
        for b, score in choices[i]:
            total, a = max((best[a][0] + joint(i, a, b), -a) for a in best)
            now[b] = (total + score, -a)
        trail.append(now)
        best = now
    path = [max(best, key=lambda b: (best[b][0], -b))]
    for now in reversed(trail[1:]):
        path.append(now[path[-1]][1])
    return path[::-1]


def _dressed(like: str, word: str) -> str:
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word


def corrected_texts(texts: DataFrame, counts: DataFrame, bigrams: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """H3: (text, corrected) for each distinct text that is not blank. ``counts`` is (word, n) over cleaned words, ``bigrams``
    (prev, token, score)."""
    rows = texts.select("text").filter(~T.is_blank("text")).distinct().select("text", F.explode(F.array(T.words("text"))).alias("words"))
    rows = write_once(rows.withColumn("id", F.monotonically_increasing_id()), "correct-texts")
    cores = F.explode(F.array(F.transform("words", core))).alias("cores")
    places = rows.select("id", cores).select("id", F.posexplode("cores").alias("place", "word"))
    vocabulary = write_once(known_words(counts, min_count), "correct-words")
    unknown = places.select("word").filter("word <> ''").distinct().join(vocabulary, "word", "left_anti")
    near = write_once(correction_candidates(unknown, vocabulary), "correct-near")
    total = counts.select(F.coalesce(F.sum("n"), F.lit(1))).scalar()

    def score(n, distance):
        return F.round((F.log(n / total) - EDIT_COST * distance) * UNIT).cast("long")

    lists = near.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "candidate", score(F.col("n").cast("double"), F.col("distance")).alias("score")))).alias("near"))
    doubtful = write_once(places.join(lists, "word"), "correct-places")

    # Bigram shares of neighbouring choices, for pairs with a choice in them.
    options = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("word").alias("candidate"))),
                       F.transform("near", lambda x: F.struct(x["rank"].alias("rank"), x["candidate"].alias("candidate"))))
    touched = doubtful.select("id", F.explode(F.array(F.col("place") - 1, F.col("place"), F.col("place") + 1)).alias("place")).distinct()
    around = places.join(touched, ["id", "place"]).join(doubtful.select("id", "place", "near"), ["id", "place"], "left").select(
        "id", "place", F.explode(F.coalesce(options, F.array(F.struct(F.lit(0).alias("rank"), F.col("word").alias("candidate"))))).alias("c"))
    around = write_once(around.select("id", "place", "c.rank", "c.candidate"), "correct-around")
    a = around.select("id", (F.col("place") + 1).alias("place"), F.col("rank").alias("a"), F.col("candidate").alias("prev"))
    b = around.select("id", "place", F.col("rank").alias("b"), F.col("candidate").alias("token"))
    steps = a.join(b, ["id", "place"]).join(bigrams, ["prev", "token"]).groupBy("id").agg(
        F.collect_list(F.struct("place", "a", "b", F.col("score").alias("share"))).alias("steps"))
    per_text = doubtful.groupBy("id").agg(F.collect_list(F.struct("place", "near")).alias("doubtful"))
    staged = rows.join(per_text, "id", "left").join(steps, "id", "left").select("text", "words", "doubtful", "steps")
    alone = round(log(0.5) * UNIT)

    def run(batches):
        import pandas as pd

        floor = round(log(FLOOR) * UNIT)
        for pdf in batches:
            out = []
            for words, doubts, shares in zip(pdf["words"], pdf["doubtful"], pdf["steps"]):
                words = list(words)
                near_at = {} if doubts is None else {d["place"]: d["near"] for d in doubts}
                if near_at:
                    share = {} if shares is None else {(s["place"], s["a"], s["b"]): s["share"] for s in shares}
                    found = [[(0, self_score)] + [(c["rank"], c["score"]) for c in near_at[i]] if i in near_at else [(0, 0)]
                             for i in range(len(words))]

                    def joint(i, a, b):
                        if i not in near_at and i - 1 not in near_at:
                            return 0
                        s = share.get((i, a, b), 0.0)
                        return floor if s == 0 else round(log(FLOOR + (1 - FLOOR) * s) * UNIT)

                    for i, b in enumerate(best_path(found, joint)):
                        if b:
                            letters = [j for j, c in enumerate(words[i]) if c.isalpha()]
                            start, end = letters[0], letters[-1] + 1
                            words[i] = words[i][:start] + _dressed(words[i][start:end], near_at[i][b - 1]["candidate"]) + words[i][end:]
                fixed = " ".join(words)
                out.append(fixed if fixed[-1:] in (".", "!", "?") else fixed + ".")
            yield pd.DataFrame({"text": pdf["text"], "corrected": out})

    log_total = counts.select(F.round(F.log(F.coalesce(F.sum("n"), F.lit(1)).cast("double")) * UNIT).cast("long")).first()[0]
    self_score = alone - log_total
    return staged.mapInPandas(run, "text string, corrected string")
