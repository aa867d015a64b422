"""Synonyms: lexicon lookup (J3, F9, U4), frequency ranking (A6, K9), contextual re-ranking
with masked-word predictions (F8, F10, H4 default, K11, J2, K10) and the request job R3.

The lexicon is two tables, ``word_synsets(word, synset_id[, pos])`` and ``synset_lemmas(synset_id,
lemma, lemma_count, ord)``; both are joined, never collected. A word with no lexicon entry is
dropped before any prediction work (the reference's empty short-circuit).

A word is looked up by its base forms (``word_senses``): per part of speech an exception table comes first, else the
word itself and what is left when an ending is detached; only where none of these is an entry, another ending is detached, up to
``DETACH_DEPTH`` of them. Entries hold underscores for spaces, and so do the words looked up. Endings are rows and
candidate forms meet the lexicon in an equi-join. A lexicon without ``pos`` is searched with all endings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraforge.functions import text as T
from paraforge.session import write_once

# The endings that the lexical database detaches, by part of speech, and what takes their place.
DETACHMENTS = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
          ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "r": [],
}
DETACH_DEPTH = 2

TOP_FREQUENCY = 8      # K9
TOP_PREDICTIONS = 100  # K11
TOP_CONTEXT = 5        # K10


def entry_form(word) -> F.Column:
    """A word as the lexicon spells it: lower case, underscores for spaces."""
    return F.replace(F.lower(word), F.lit(" "), F.lit("_"))


def _endings(tagged: bool) -> F.Column:
    """All detachment rules as one array of (pos, old, new); pos is '' for a lexicon without parts of speech."""
    rows = list(dict.fromkeys((pos if tagged else "", old, new) for pos, rules in DETACHMENTS.items() for old, new in rules))
    return F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(o).alias("old"), F.lit(n).alias("new")) for p, o, n in rows])


def _swap_ending(forms: DataFrame, tagged: bool, take: str, put: str) -> DataFrame:
    """Each form with one ending ``take`` replaced by ``put``, for all rules of its part of speech."""
    fits = F.filter(_endings(tagged), lambda r: (r["pos"] == F.col("pos")) & F.endswith(F.col("form"), r[take]))
    out = forms.withColumn("r", F.explode(fits))
    cut = F.left("form", F.length("form") - F.length(F.col(f"r.{take}")))
    return out.withColumn("form", F.concat(cut, F.col(f"r.{put}"))).drop("r")


def _steps(forms: DataFrame, tagged: bool, take: str, put: str, depth: int) -> DataFrame:
    """(..., form, step): the forms themselves (step 1) and after one (1) to ``depth`` swapped endings."""
    out = now = forms.withColumn("step", F.lit(1))
    for step in range(1, depth + 1):
        now = _swap_ending(now, tagged, take, put).withColumn("step", F.lit(step)).distinct()
        out = out.unionByName(now)
    return out


def _parts(df: DataFrame, tagged: bool) -> DataFrame:
    return df.withColumn("pos", F.explode(F.array(*map(F.lit, DETACHMENTS if tagged else [""]))))


def _exceptions(exceptions: DataFrame, tagged: bool) -> DataFrame:
    """(pos, key, form): what an excepted form may stand for, itself included."""
    rows = exceptions.select((F.col("pos") if tagged else F.lit("")).alias("pos"), entry_form("form").alias("key"),
                             F.explode(F.array(entry_form("form"), entry_form("base"))).alias("form"))
    return rows.distinct()


def _nearest(found: DataFrame) -> DataFrame:
    """Per key and part of speech, the senses at the least number of steps."""
    least = F.min("step").over(Window.partitionBy("key", "pos"))  # the few forms of one key
    near = found.filter(F.col("key").isNotNull()).withColumn("_pf_least", least).filter(F.col("step") == F.col("_pf_least"))
    return near.select("key", "pos", "form", "synset_id").distinct()


def word_senses(words: DataFrame, word_synsets: DataFrame, exceptions: DataFrame | None = None, word: str = "word",
                depth: int = DETACH_DEPTH) -> DataFrame:
    """J3, first half: (lword, form, synset_id): for each distinct lower-cased word the synsets of its base
    forms. ``exceptions`` is (pos, form, base). Two forms of a word that share a synset give it twice."""
    tagged = "pos" in word_synsets.columns
    entries = word_synsets.select(F.col("word").alias("form"), (F.col("pos") if tagged else F.lit("")).alias("pos"), "synset_id")
    keys = words.select(F.lower(F.col(word)).alias("lword")).distinct().withColumn("key", entry_form("lword"))
    parts = _parts(keys.select("key").distinct(), tagged)
    if exceptions is None:
        forms = _steps(parts.withColumn("form", F.col("key")), tagged, "old", "new", depth)
    else:
        table = _exceptions(exceptions, tagged)
        ruled = parts.join(table.select("pos", "key"), ["pos", "key"], "left_anti").withColumn("form", F.col("key"))
        forms = _steps(ruled, tagged, "old", "new", depth).unionByName(
            parts.join(table, ["pos", "key"]).withColumn("step", F.lit(1)))
    return keys.join(_nearest(forms.join(entries, ["form", "pos"])), "key").select("lword", "form", "synset_id")


def lexicon_entries(words: DataFrame, word_synsets: DataFrame, synset_lemmas: DataFrame,
                    word: str = "word", exceptions: DataFrame | None = None) -> DataFrame:
    """Each input row with every lemma of every synset of its word's base forms."""
    senses = word_senses(words, word_synsets, exceptions, word).select(F.col("lword").alias("_pf_w"), "synset_id")
    keyed = words.withColumn("_pf_w", F.lower(F.col(word)))
    return keyed.join(senses, "_pf_w").join(synset_lemmas, "synset_id").drop("_pf_w")


# A unit of the meeting of words and names is at most about so many rows of each.
WORD_BLOCK, NAME_BLOCK = 16_384, 4_096


def _named(synset_lemmas: DataFrame, name: F.Column, *measures: F.Column) -> DataFrame:
    """(synset_id, name, here, homes): each different name of a synset, and ``homes``, the array of all synsets that have
    the name as structs of synset_id and the measures. A name's homes are its own few senses."""
    one = synset_lemmas.select("synset_id", name.alias("name"), *[c for c in synset_lemmas.columns if c in ("lemma_count", "ord")])
    one = one.filter(F.col("synset_id").isNotNull() & F.col("name").isNotNull()).groupBy("synset_id", "name").agg(
        F.count(F.lit(1)).alias("rows"), *measures)
    homes = one.groupBy("name").agg(F.collect_list(F.struct("synset_id", *[c for c in one.columns if c not in ("synset_id", "name")])).alias("homes"))
    return write_once(homes.select("name", "homes", F.explode("homes.synset_id").alias("synset_id")), "synset-names")


def _met(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with a column synset_id joined with ``names``. Both sides of a large synset are dealt to blocks, so that no task
    meets all its words with all its names."""
    n = rows.groupBy("synset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    m = names.groupBy("synset_id").agg(F.count(F.lit(1)).alias("n_names"))
    sizes = n.join(m, "synset_id").select(
        "synset_id", F.ceil(F.col("n_rows") / WORD_BLOCK).cast("int").alias("_pf_rb"), F.ceil(F.col("n_names") / NAME_BLOCK).cast("int").alias("_pf_nb"))
    large = write_once(sizes.filter((F.col("_pf_rb") > 1) | (F.col("_pf_nb") > 1)), "large-synsets")

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        blocks = df.join(large, "synset_id", "left").na.fill(1, ["_pf_rb", "_pf_nb"])
        blocks = blocks.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(n_own)).cast("int"))
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_pf_rb", "_pf_nb")

    left = dealt(rows, "_pf_b", "_pf_rb", "_pf_c", "_pf_nb")
    right = dealt(names, "_pf_c", "_pf_nb", "_pf_b", "_pf_rb")
    return left.join(right.hint("merge"), ["synset_id", "_pf_b", "_pf_c"]).drop("_pf_b", "_pf_c")


def _word_synsets_of(words: DataFrame, word_synsets: DataFrame, exceptions: DataFrame | None, word: str) -> DataFrame:
    """(lword, mine): for each distinct lower-cased word the array of its synsets with the number of forms that have it."""
    asked = write_once(words.select(word).distinct(), "looked-up-words")
    senses = word_senses(asked, word_synsets, exceptions, word).groupBy("lword", "synset_id").agg(F.count(F.lit(1)).alias("times"))
    return write_once(senses.groupBy("lword").agg(F.collect_list(F.struct("synset_id", "times")).alias("mine")), "word-senses")


def _shared() -> F.Column:
    """The homes of a name that are synsets of the word, with the word's ``times``. A name is taken where it is met in the
    least of them, so that no pair of word and name comes twice and none needs a shuffle to be told apart."""
    mine = F.map_from_entries("mine")
    return F.filter(F.transform("homes", lambda h: F.struct(
        h["synset_id"].alias("synset_id"), h.alias("home"), F.element_at(mine, h["synset_id"]).alias("times"))), lambda x: x["times"].isNotNull())


def _names_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(columns of ``rows``, name, shared): each row (..., mine) with each different name of its synsets, once."""
    met = _met(rows.withColumn("synset_id", F.explode("mine.synset_id")), names)
    met = met.withColumn("shared", F.explode(F.array(_shared())))
    return met.filter(F.col("synset_id") == F.array_min(F.transform("shared", lambda x: x["synset_id"]))).drop("mine", "homes", "synset_id")


def _below(ids) -> F.Column:
    """Those of ``ids`` that come before the row's synset_id."""
    return F.filter(ids, lambda s: s < F.col("synset_id"))


def _candidates_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(columns of ``rows``, name): each row (..., senses) with each different name of its synsets, once: a name is taken where
    the row and the name have no synset in common before the one they meet in. ``names`` is ``_single_names``."""
    rows = rows.withColumn("synset_id", F.explode("senses")).withColumn("senses", _below("senses"))
    # Most pairs are told apart without the set that an overlap builds for each.
    met_before = F.when((F.size("senses") == 0) | (F.size("before") == 0), F.lit(False)).when(
        (F.size("senses") == 1) & (F.size("before") == 1), F.get("senses", F.lit(0)) == F.get("before", F.lit(0))).otherwise(
        F.arrays_overlap("senses", "before"))
    return _met(rows, names).filter(~met_before).drop("senses", "before", "synset_id")


def lexicon_candidates(words: DataFrame, word_synsets: DataFrame, synset_lemmas: DataFrame,
                       key: str = "request_id", word: str = "word", exceptions: DataFrame | None = None) -> DataFrame:
    """J3 -> F9 -> U4: (key, candidate) distinct single-word lower-cased synonyms."""
    asked = words.select(F.col(key).alias("_pf_k"), F.lower(F.col(word)).alias("lword")).filter(F.col("lword").isNotNull()).distinct()
    mine = _word_synsets_of(words.select(word), word_synsets, exceptions, word).select("lword", F.col("mine.synset_id").alias("senses"))
    asked = write_once(asked.join(mine, "lword"), "asked-words")
    found = _candidates_of(asked, _single_names(synset_lemmas)).filter(F.col("name") != F.col("lword")).select("_pf_k", "lword", "name")
    # A candidate can come twice for a key only if the key has several words.
    several = asked.groupBy("_pf_k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("_pf_k").alias("_pf_s"))
    several = write_once(several, "keys-of-several-words")
    same = F.col("_pf_k").eqNullSafe(F.col("_pf_s"))
    if several.isEmpty():
        return found.select(F.col("_pf_k").alias(key), F.col("name").alias("candidate"))
    once, more = found.join(several, same, "left_anti"), found.join(several, same, "left_semi")
    return once.select("_pf_k", "name").unionByName(more.select("_pf_k", "name").distinct()).select(
        F.col("_pf_k").alias(key), F.col("name").alias("candidate"))


def _single_names(synset_lemmas: DataFrame) -> DataFrame:
    """(synset_id, name, before): each different single-word name of a synset, and those of the name's few synsets that come before it."""
    surface = T.lemma_surface("lemma")
    one = synset_lemmas.filter(~surface.contains(" ")).select("synset_id", F.lower(surface).alias("name"))
    homes = one.filter(F.col("synset_id").isNotNull() & F.col("name").isNotNull()).groupBy("name").agg(F.collect_set("synset_id").alias("homes"))
    return write_once(homes.select("name", "homes", F.explode("homes").alias("synset_id")).select(
        "synset_id", "name", _below("homes").alias("before")), "synset-names")


def synonym_frequency(words: DataFrame, word_synsets: DataFrame, synset_lemmas: DataFrame,
                      word: str = "word", exceptions: DataFrame | None = None) -> DataFrame:
    """Per word, summed lemma counts per surface name (underscores as spaces, case kept,
    the word itself skipped), with the first-seen order for ties."""
    asked = words.select(F.col(word).alias("_pf_w"), F.lower(F.col(word)).alias("lword")).filter(F.col("lword").isNotNull()).distinct()
    asked = write_once(asked.join(_word_synsets_of(words.select(word), word_synsets, exceptions, word), "lword"), "asked-words")
    names = _named(synset_lemmas, T.lemma_surface("lemma"), F.sum("lemma_count").cast("long").alias("lemma_count"),
                   F.min("ord").cast("long").alias("ord"))
    found = _names_of(asked, names).filter(F.lower("name") != F.col("lword"))
    counts = F.filter(F.transform("shared", lambda x: x["home"]["lemma_count"] * x["times"]), lambda c: c.isNotNull())
    freq = F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c))
    return found.select(F.col("_pf_w").alias(word), "name", freq.alias("freq"),
                        F.array_min(F.transform("shared", lambda x: x["home"]["ord"])).alias("first_ord"))


def topk_synonyms(freq: DataFrame, k: int = TOP_FREQUENCY, word: str = "word") -> DataFrame:
    """K9: the k most frequent names per word; ties in first-seen order."""
    w = Window.partitionBy(word).orderBy(F.desc("freq"), "first_ord")
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_predictions(preds: DataFrame, key: str, k: int = TOP_PREDICTIONS) -> DataFrame:
    """The k best tokens per key (score desc, token asc)."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "token")
    return preds.withColumn("_pf_rk", F.row_number().over(w)).filter(F.col("_pf_rk") <= k).drop("_pf_rk")


def fold_predictions(preds: DataFrame, key: str = "request_id") -> DataFrame:
    """F10 for a user predictor's output: strip + lower each token; when two tokens fold to the
    same text, the one ranked later (lower score) wins, as a dict built in rank order keeps the
    last value."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "token")
    ranked = preds.withColumn("_pf_rk", F.row_number().over(w)).withColumn("token", T.prediction_token("token"))
    return ranked.groupBy(key, "token").agg(F.max_by("score", "_pf_rk").alias("score"))


def mask_requests(requests: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """F8 on a request table: adds ``masked``."""
    return requests.withColumn("masked", T.mask_word(F.col(text), F.col(word)))


def left_of_mask(masked) -> F.Column:
    """The cleaned word right before [MASK] ('' when there is none)."""
    raw = F.regexp_extract(masked, r"(?U)(\S+)\s+\[MASK\]", 1)
    return F.regexp_replace(F.lower(raw), r"(?U)[^\p{L}]", "")


def bigram_predictor(bigrams: DataFrame, k: int = TOP_PREDICTIONS) -> Callable[[DataFrame], DataFrame]:
    """H4 default: the masked word is predicted from its left neighbour, with the share of each
    token among the words that follow that neighbour in the corpus. The top k per neighbour is
    cut before the join (a partial top-k per task), so a common neighbour never expands every
    request by its whole follower list. ``by_left`` is the table of these, for callers that join lists by the neighbour."""
    top = top_predictions(bigrams, "prev", k)

    def predict(masked: DataFrame, key: str = "request_id") -> DataFrame:
        ctx = masked.select(key, left_of_mask(F.col("masked")).alias("prev")).filter(F.col("prev") != "")
        return ctx.join(top, "prev").select(key, "token", "score")

    predict.by_left = top
    return predict


def predicted_senses(top: DataFrame, synset_lemmas: DataFrame) -> DataFrame:
    """(prev, predictions array<struct<token, score, homes>>): the positive predictions (prev, token, score) of each left neighbour
    that are usable lemmas, best first, with the synsets that have them. A token's homes are its own few senses."""
    name = T.lemma_surface("lemma")
    homes = synset_lemmas.filter(~name.contains(" ")).groupBy(F.lower(name).alias("token")).agg(F.collect_set("synset_id").alias("homes"))
    found = top.filter((F.col("score") > 0) & (F.col("prev") != "")).join(homes, "token")
    lists = found.groupBy("prev").agg(F.collect_set(F.struct("token", "score", "homes")).alias("all"))  # what is shuffled holds a score once
    best = F.sort_array(F.transform("all", lambda p: F.struct((-p["score"]).alias("order"), p["token"], p["score"], p["homes"])))
    return lists.select("prev", F.transform(best, lambda p: F.struct(p["token"], p["score"], p["homes"])).alias("predictions"))


def _usable(predictions, senses, lword) -> F.Column:
    """The predictions that are a lemma of one of the word's senses and not the word itself, best first."""
    return F.filter(predictions, lambda p: F.arrays_overlap(p["homes"], senses) & (p["token"] != lword))


def _sense_sets(requests: DataFrame, word_synsets: DataFrame, exceptions: DataFrame | None) -> DataFrame:
    """(lword, senses): the synsets of each asked word."""
    return word_senses(requests, word_synsets, exceptions, "word").groupBy("lword").agg(F.collect_set("synset_id").alias("senses"))


def _predicted_hits(requests: DataFrame, senses: DataFrame, top: DataFrame, synset_lemmas: DataFrame, key: str) -> DataFrame:
    """(key, word, lword, masked, senses, hits): every request with its usable predictions. A request meets two lists, the synsets
    of its word (``senses``) and the predictions of its left neighbour, and what they share is found in the row: no pair of request
    and prediction is shuffled. A request whose word has no entry or is not in the text meets no prediction."""
    masked = T.mask_word(F.col("text"), F.col("word"))
    rows = requests.select(key, "word", F.lower("word").alias("lword"), F.explode(F.array(masked)).alias("m")).select(
        key, "word", "lword", F.coalesce(F.col("m").contains(T.MASK_TOKEN), F.lit(False)).alias("masked"), left_of_mask(F.col("m")).alias("prev"))
    met = rows.join(senses, "lword", "left")
    asked = F.col("masked") & F.col("senses").isNotNull() & F.col(key).isNotNull() & (F.col("prev") != "")
    # No neighbour starts with a space: what asks for nothing is spread by its key.
    prev = F.when(asked, F.col("prev")).otherwise(F.concat(F.lit(" "), F.xxhash64(key, "word").cast("string")))
    met = met.withColumn("prev", prev).join(predicted_senses(top, synset_lemmas), "prev", "left")
    return met.select(key, "word", "lword", "masked", "senses", _usable(F.col("predictions"), F.col("senses"), F.col("lword")).alias("hits"))


def _by_own_key(requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The requests whose key no other has, and the others (None if there are none): rows of one key are answered together."""
    several = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    several = write_once(several, "repeated-keys")
    if several.isEmpty():
        return requests, None
    return requests.join(several, key, "left_anti"), requests.join(several, key, "left_semi")


def word_candidates(words: DataFrame, word_synsets: DataFrame, synset_lemmas: DataFrame,
                    word: str = "word", exceptions: DataFrame | None = None) -> DataFrame:
    """J3 -> F9 -> U4 per distinct word: (lword, candidate), ``lword`` the lower-cased word.
    Computed once per word, not once per request that uses it."""
    mine = _word_synsets_of(words, word_synsets, exceptions, word).select("lword", F.col("mine.synset_id").alias("senses"))
    found = _candidates_of(mine, _single_names(synset_lemmas))
    return found.filter(F.col("name") != F.col("lword")).select("lword", F.col("name").alias("candidate"))


def contextual_synonyms(requests: DataFrame, word_synsets: DataFrame, synset_lemmas: DataFrame,
                        predictor: Callable[[DataFrame], DataFrame], key: str = "request_id",
                        k: int = TOP_CONTEXT, exceptions: DataFrame | None = None) -> DataFrame:
    """(key, word, synonyms array<string>) ranked by the context score, cut to k, zero
    scores dropped. Requests whose word has no lexicon entry, or does not occur as a whole word,
    get an empty list without any prediction work.

    "Sort all candidates by score, cut to k, drop zeros" equals "the k best candidates with a
    positive score", so the join runs from the predictions (at most the predictor's top 100 per
    request): a predicted token is kept when it is a usable lemma (F9) of one of the word's
    synsets. The lexicon is never expanded to every candidate of every request. With a predictor that knows the left
    neighbour only (``by_left``) this is decided in the request's row.
    """
    top = getattr(predictor, "by_left", None)
    if top is None:
        return _contextual_by_pairs(requests, word_synsets, synset_lemmas, predictor, key, k, exceptions)
    own, shared = _by_own_key(requests, key)
    lists = _predicted_hits(own, _sense_sets(own, word_synsets, exceptions), top, synset_lemmas, key)
    best = F.transform(F.slice("hits", 1, k), lambda p: p["token"])
    out = lists.select(key, "word", F.coalesce(best, F.array().cast("array<string>")).alias("synonyms"))
    if shared is None:
        return out
    return out.unionByName(_contextual_by_pairs(shared, word_synsets, synset_lemmas, predictor, key, k, exceptions))


def _contextual_by_pairs(requests: DataFrame, word_synsets: DataFrame, synset_lemmas: DataFrame, predictor: Callable[[DataFrame], DataFrame],
                         key: str, k: int, exceptions: DataFrame | None) -> DataFrame:
    """``contextual_synonyms`` for any predictor (one row a prediction) and for keys of several requests."""
    reqs = requests.select(key, "word", "text").withColumn("lword", F.lower("word"))
    senses = word_senses(reqs, word_synsets, exceptions, "lword").select("lword", "synset_id").distinct()
    masked = mask_requests(reqs.join(senses.select("lword").distinct(), "lword", "left_semi"))
    masked = masked.filter(F.col("masked").contains(T.MASK_TOKEN))
    preds = predictor(masked).filter(F.col("score") > 0)
    name = T.lemma_surface("lemma")
    lemmas = synset_lemmas.filter(~name.contains(" ")).select("synset_id", F.lower(name).alias("token")).distinct()
    scored = (preds.join(masked.select(key, "lword"), key)
              .join(senses, "lword")
              .join(lemmas, ["synset_id", "token"])
              .filter(F.col("token") != F.col("lword"))
              .select(key, "token", "score").distinct())
    w = Window.partitionBy(key).orderBy(F.desc("score"), "token")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    lists = ranked.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda s: s["token"]).alias("synonyms"))
    out = requests.select(key, "word").join(lists, key, "left")
    return out.withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))


def score_lookup(requests: DataFrame, word_synsets: DataFrame, synset_lemmas: DataFrame, predictor: Callable[[DataFrame], DataFrame],
                 key: str = "request_id", exceptions: DataFrame | None = None, positive: bool = False) -> DataFrame:
    """(key, candidate, score): each lexicon candidate of a masked request with its context score, 0.0 when the predictor did
    not rank it; with ``positive`` only those above 0, which are found from the predictions and never expanded. With a predictor
    that knows the left neighbour only, a request carries its few scored candidates to the expansion, and the pairs of request
    and candidate are not shuffled."""
    def by_pairs(reqs: DataFrame) -> DataFrame:
        cands = lexicon_candidates(reqs, word_synsets, synset_lemmas, key, exceptions=exceptions)
        masked = mask_requests(reqs).filter(F.col("masked").contains(T.MASK_TOKEN))
        preds = predictor(masked)
        out = cands.join(masked.select(key), key, "left_semi").join(preds.withColumnRenamed("token", "candidate"), [key, "candidate"], "left")
        out = out.select(key, "candidate", F.coalesce("score", F.lit(0.0)).alias("score"))
        return out.filter("score > 0") if positive else out

    top = getattr(predictor, "by_left", None)
    if top is None:
        return by_pairs(requests)
    own, shared = _by_own_key(requests, key)
    scored = lambda p: F.struct(p["token"].alias("candidate"), p["score"].alias("score"))
    if positive:
        hits = _predicted_hits(own, _sense_sets(own, word_synsets, exceptions), top, synset_lemmas, key)
        hits = hits.filter(F.col("masked") & F.col(key).isNotNull())
        out = hits.select(key, F.inline(F.transform("hits", scored)))
    else:
        mine = _word_synsets_of(own, word_synsets, exceptions, "word").select("lword", F.col("mine.synset_id").alias("senses"))
        hits = _predicted_hits(own, mine, top, synset_lemmas, key).filter(F.col("masked") & F.col(key).isNotNull() & F.col("senses").isNotNull())
        # Read for the sizes of the synsets and for the pairs: written, so that predictions and senses are worked out once.
        asked = write_once(hits.select(key, "lword", "senses", F.col("hits.token").alias("few"), F.col("hits.score").alias("scores")), "asked-words")
        found = _candidates_of(asked, _single_names(synset_lemmas)).filter(F.col("name") != F.col("lword"))
        # No lambda: the whole expansion stays one generated loop.
        score = F.when(F.size("few") > 0, F.get("scores", (F.array_position("few", F.col("name")) - 1).cast("int")))
        out = found.select(key, F.col("name").alias("candidate"), F.coalesce(score, F.lit(0.0)).alias("score"))
    return out if shared is None else out.unionByName(by_pairs(shared))


def form_senses(word_synsets: DataFrame, exceptions: DataFrame | None = None, depth: int = DETACH_DEPTH) -> DataFrame:
    """(key, senses): every word form that ``word_senses`` finds, with its synsets. The endings are put
    on the lexicon's entries instead of being taken off a word, so that a stream can look a form up by one join."""
    return _form_synsets(word_synsets, exceptions, depth).groupBy("key").agg(F.collect_set("synset_id").alias("senses"))


def known_forms(word_synsets: DataFrame, synset_lemmas: DataFrame, exceptions: DataFrame | None = None,
                depth: int = DETACH_DEPTH) -> DataFrame:
    """(key, candidates): every word form that ``word_senses`` finds, with its usable single-word lemmas. A list repeats the lemmas
    of its synsets for each form: for small lexicons; ``form_senses`` holds the synsets only."""
    name = T.lemma_surface("lemma")
    lemmas = synset_lemmas.filter(~name.contains(" ")).select("synset_id", F.lower(name).alias("token"))
    return (_form_synsets(word_synsets, exceptions, depth).join(lemmas, "synset_id")
            .groupBy("key").agg(F.collect_set("token").alias("candidates")))


def _form_synsets(word_synsets: DataFrame, exceptions: DataFrame | None, depth: int) -> DataFrame:
    """(key, synset_id) of all word forms."""
    tagged = "pos" in word_synsets.columns
    entries = word_synsets.select(F.col("word").alias("base"), (F.col("pos") if tagged else F.lit("")).alias("pos"), "synset_id")
    bases = entries.select("base", "pos").distinct().withColumn("form", F.col("base"))
    if not tagged:
        bases = bases.withColumn("pos", F.lit(""))
    grown = _steps(bases, tagged, "new", "old", depth).select(F.col("form").alias("key"), "pos", F.col("base").alias("form"), "step")
    if exceptions is not None:
        table = _exceptions(exceptions, tagged)
        grown = grown.join(table.select("pos", "key").distinct(), ["pos", "key"], "left_anti").unionByName(
            table.withColumn("step", F.lit(1)).select("key", "pos", "form", "step"))
    senses = _nearest(grown.join(entries.withColumnRenamed("base", "form"), ["form", "pos"]))
    return senses.select("key", "synset_id").distinct()


def ranked_predictions(bigrams: DataFrame, k: int = TOP_PREDICTIONS) -> DataFrame:
    """(prev, predictions): the positive predictions of ``bigram_predictor`` for each left neighbour, best first."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "token")))
    return top_predictions(bigrams, "prev", k).filter("score > 0").groupBy("prev").agg(
        F.transform(best, lambda p: p["token"]).alias("predictions"))


def contextual_synonyms_stream(requests: DataFrame, forms: DataFrame, predictions: DataFrame, key: str = "request_id",
                               k: int = TOP_CONTEXT) -> DataFrame:
    """R3 for an unbounded input: the request joins two static tables, one by its word (``form_senses``, or ``known_forms``) and one by
    the mask's left neighbour (``predicted_senses``, or ``ranked_predictions``), and the list is ranked and cut inside the row's
    array. No state; the result equals ``contextual_synonyms`` with ``bigram_predictor``."""
    masked = T.mask_word(F.col("text"), F.col("word"))
    rows = requests.select(key, "word", F.lower("word").alias("lword"), entry_form("word").alias("key"),
                           F.when(masked.contains(T.MASK_TOKEN), left_of_mask(masked)).alias("prev"))
    met = rows.join(forms, "key", "left").join(predictions.filter("prev <> ''"), "prev", "left")
    if "senses" in forms.columns:
        usable = F.transform(_usable(F.col("predictions"), F.col("senses"), F.col("lword")), lambda p: p["token"])
    else:
        usable = F.filter("predictions", lambda t: F.array_contains("candidates", t) & (t != F.col("lword")))
    return met.select(key, "word", F.coalesce(F.slice(usable, 1, k), F.array().cast("array<string>")).alias("synonyms"))
