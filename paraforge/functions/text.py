"""Text operators as Column expressions.

All of these compile to JVM expressions (regex, higher-order array functions), stay inside
whole-stage codegen where Spark allows it, and run unchanged on batch tables and streams.
Regexes carry ``(?U)`` so that ``\\s``, ``\\w`` and ``\\b`` follow Unicode classes the way
Python's ``str.split``/``re`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# Abbreviations whose trailing period never ends a sentence (case-sensitive, word-bounded):
ABBREVIATIONS = [
    "Dr", "Mr", "Mrs", "Ms", "Jr", "Sr", "Prof",
    "vs", "etc", "e.g", "i.e", "U.S", "U.K", "U.N",
    "Inc", "Ltd", "Co", "St",
]
# Placeholder that stands in for a protected period while splitting; any literal occurrence in
# the input also turns into a period, as in the reference.
PERIOD_PLACEHOLDER = "<PERIOD>"
# Prompt prefixes of the generator and the corrector.
PARAPHRASE_PREFIX = "paraphrase: "
GRAMMAR_PREFIX = "grammar: "
# Token that replaces the target word for the masked-word predictor.
MASK_TOKEN = "[MASK]"
# ---------------------------------------------------------------------------------------------

# White space as a text's split() sees it: Unicode white space and the separators U+001C to U+001F.
_WS = r"[\s\x1c-\x1f]"
WS_SPLIT = rf"(?U){_WS}+"
_TRIM = rf"(?U)^{_WS}+|{_WS}+\z"
_ABBR_PATTERN = r"(?U)\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\."
_SENTENCE_BREAK = rf"(?U)(?<=[.!?]){_WS}+(?=[A-Z])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utrim(text) -> Column:
    """Strip Unicode whitespace at both ends (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(text), _TRIM, "")


def words(text) -> Column:
    """``str.split()``: Unicode-whitespace split with no empty pieces; NULL text gives []."""
    return F.array_remove(F.split(F.coalesce(_c(text), F.lit("")), WS_SPLIT), "")


def word_tokens(text) -> Column:
    """Lower-cased words, duplicates kept (term-frequency input)."""
    return words(F.lower(_c(text)))


def tokens(text) -> Column:
    """the set of lower-cased whitespace tokens (punctuation stays on the word)."""
    return F.array_distinct(word_tokens(text))


def overlap_from_tokens(ta, tb) -> Column:
    """F2 on two token sets: |A & B| / |A | B|, 0.0 when either side is empty."""
    ta, tb = _c(ta), _c(tb)
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(ta) + F.size(tb) - inter
    return (
        F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
        .otherwise(inter.cast("double") / union.cast("double"))
    )


def word_overlap(a, b) -> Column:
    """token-set Jaccard of two texts."""
    return overlap_from_tokens(tokens(a), tokens(b))


def split_sentences(text) -> Column:
    """protect abbreviations, split after [.!?] + whitespace before an ASCII capital,
    restore periods, trim, drop empty pieces (P12). Order of sentences is kept."""
    protected = F.regexp_replace(_c(text), _ABBR_PATTERN, "$1" + PERIOD_PLACEHOLDER)
    pieces = F.split(utrim(protected), _SENTENCE_BREAK)
    restored = F.transform(pieces, lambda s: utrim(F.replace(s, F.lit(PERIOD_PLACEHOLDER), F.lit("."))))
    return drop_empty(restored)


def drop_empty(arr) -> Column:
    """Remove empty strings from an array."""
    return F.filter(_c(arr), lambda s: s != "")


def proper_nouns(text) -> Column:
    """words after the first whose first character (after stripping non-word characters)
    is upper case; lower-cased, distinct."""
    cleaned = F.transform(
        F.filter(words(text), lambda w, i: i > 0),
        lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""),
    )
    capital = F.filter(cleaned, lambda w: w.rlike(r"^\p{Lu}"))
    return F.array_distinct(F.transform(capital, lambda w: F.lower(w)))


def numbers(text) -> Column:
    """distinct digit runs, as strings."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"(?U)(\d+)"), 1))


def new_entities_from(nouns, known_nouns, nums, known_nums) -> Column:
    """F6 on entity sets: some proper noun or number is not among the known ones."""
    return (F.size(F.array_except(_c(nouns), _c(known_nouns))) > 0) | (F.size(F.array_except(_c(nums), _c(known_nums))) > 0)


def introduces_new_entities(original, candidate) -> Column:
    """the candidate has a proper noun or number that the original lacks."""
    return new_entities_from(proper_nouns(candidate), proper_nouns(original), numbers(candidate), numbers(original))


def _quote_regex(word: Column) -> Column:
    # \Q..\E literal quoting; a literal \E inside the word is closed and re-opened.
    return F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def mask_word(sentence, word) -> Column:
    """F8: replace the first whole-word, case-insensitive occurrence of ``word`` by [MASK].

    ``regexp_replace`` replaces every match, so the pattern anchors at the start and keeps the
    shortest prefix: only the first occurrence is rewritten. The pattern is a per-row Column.
    """
    pattern = F.concat(F.lit(r"(?isU)^(.*?)\b"), _quote_regex(_c(word)), F.lit(r"\b"))
    return F.regexp_replace(_c(sentence), pattern, F.lit("$1" + MASK_TOKEN))


def lemma_surface(lemma) -> Column:
    """F9 (first half): lexicon lemma name as text: underscores become spaces."""
    return F.replace(_c(lemma), F.lit("_"), F.lit(" "))


def usable_synonym(lemma, word) -> Column:
    """F9 (filter): not the word itself (case-insensitive) and a single word."""
    name = lemma_surface(lemma)
    return (F.lower(name) != F.lower(_c(word))) & ~name.contains(" ")


def prediction_token(token) -> Column:
    """strip and lower-case a predicted token."""
    return F.lower(utrim(token))


def _json_list(literal) -> Column:
    """A list literal as JSON reads it, or NULL: ``\\xNN`` escapes, which JSON lacks, are rewritten to ``\\u00NN`` (an escaped
    backslash before an x is none), tuples become lists, and a comma before the end goes."""
    fixed = F.regexp_replace(literal, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    fixed = F.regexp_replace(fixed, r"(?s)^\s*\((.*)\)\s*\z", "[$1]")
    fixed = F.regexp_replace(fixed, r",\s*\]\s*\z", "]")
    return F.from_json(fixed, "array<string>")


def _literal_list(literals):
    """Lists or tuples of strings, numbers and None by the language's own literal grammar, None for anything else."""
    import ast
    import warnings

    import pandas as pd

    def one(literal):
        if literal is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # unknown escapes stay as they are
                value = ast.literal_eval(literal)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        if not isinstance(value, (list, tuple)) or any(not isinstance(x, (str, int, float, complex, type(None))) for x in value):
            return None
        # A pair of surrogate escapes is one character; half a pair has no text form.
        return [None if x is None else str(x).encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in value]

    return pd.Series([one(x) for x in literals], dtype=object)


def parse_paraphrase_list(literal) -> Column:
    """P5: a list literal string to array<string>, NULL for what is no list or tuple of strings, numbers and None.

    Two tiers: what JSON reads the same way stays in the JVM. Only other literals (numbers and None among the items, joined or
    prefixed strings, triple quotes, octal, ``\\N{}`` and unknown escapes, surrogate pairs) are sent to an Arrow
    batch that parses them by the literal grammar."""
    text = _c(literal)
    simple = _json_list(text)
    rest = F.regexp_replace(text, r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'""", "")
    same = rest.rlike(r"^\s*(\[[\s,]*\]|\([\s,]*\))\s*\z") & ~text.rlike(r"\\/|\\u[dD][89a-fA-F]")
    both = F.struct(F.when(same, simple).alias("simple"), text.alias("text"))
    full = F.pandas_udf(_literal_list, "array<string>")
    return F.coalesce(both["simple"], full(F.when(both["simple"].isNull(), both["text"])))


def first_paraphrase(arr) -> Column:
    """Element 0, NULL when the list is empty."""
    return F.get(_c(arr), 0)


def prompt_prefix(text, prefix: str = PARAPHRASE_PREFIX) -> Column:
    """Model task prefix."""
    return F.concat(F.lit(prefix), _c(text))


def is_blank(text) -> Column:
    """P10: NULL, empty or whitespace-only text (no model call, not confident)."""
    return _c(text).isNull() | (utrim(text) == "")


def list_literal(arr) -> Column:
    """Render array<string> as a double-quoted list literal (JSON-compatible)."""
    def esc(s):
        s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        s = F.replace(s, F.lit('"'), F.lit('\\"'))
        s = F.replace(s, F.lit("\n"), F.lit("\\n"))
        s = F.replace(s, F.lit("\r"), F.lit("\\r"))
        return F.replace(s, F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), lambda s: F.concat(F.lit('"'), esc(s), F.lit('"'))), ", "), F.lit("]"))
