"""Language identification by string-kernel classification.

The kernel is the blended-spectrum presence kernel: the number of byte n-grams (1 to 3 bytes, A-Z
lower-cased, digits and white space each folded to one byte) that two texts both contain, over
n-grams known from the landmarks, normalised to 1 for equal texts. ``LANDMARKS`` texts per language give
the Nystrom features K(x, landmarks) K(landmarks, landmarks)^-1/2, and kernel ridge regression
is fitted on them, one language against the rest.

Fitting uses a bounded sample (``SAMPLE`` labelled documents per language, chosen by a hash of the id),
and only n-gram sets of these texts reach the driver. Landmarks, whitening and regression multiply to
one matrix (n-grams x languages), so a batch of whole texts is scored by one product of its
presence matrix with it. A prediction sees nothing but the text.

A null text, or one without a letter, is ``und`` with score 0. Texts that share no n-gram with any landmark
get the most frequent language with score 0. Without labelled rows everything is ``und``. Ties go
to the language with more sampled documents, then to the first by code point. Rows with a null id are never learned
from and not held out; repeated rows are predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraforge.llm.common import table, text_key, unused
from paraforge.llm.words import slices

SAMPLE = 300
LANDMARKS = 60
RIDGE = 1e-2
UNKNOWN = "und"
ROWS = 64
#: Codes of 1-, 2- and 3-grams follow each other.
BASES = (0, 1 << 8, (1 << 8) + (1 << 16))
CODES = BASES[2] + (1 << 24)


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[9:14] = 32
    return fold


FOLD = _fold()


def gram_codes(data: np.ndarray, off: np.ndarray):
    """(code, row) of every n-gram of a slice of texts; none runs over the end of a text."""
    if len(data) == 0:
        return
    x = FOLD[data].astype(np.int32)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    left = off[1:][row] - np.arange(len(data))
    code = x
    for n, base in enumerate(BASES, 1):
        if n > 1:
            if len(data) < n:
                return
            code = (code[:-1] << 8) | x[n - 1:]
        ok = left[:len(code)] >= n
        yield code[ok] + base, row[:len(code)][ok]


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII one are decoded."""
    ascii_letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    count = np.concatenate([[0], np.cumsum(ascii_letter)])[off]
    found = np.diff(count) > 0
    for i in np.flatnonzero(~found):
        text = data[off[i]:off[i + 1]]
        if len(text) and text.max() > 127:
            found[i] = any(c.isalpha() for c in text.tobytes().decode("utf-8"))
    return found


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray    # known n-grams
    weights: np.ndarray  # one row per n-gram, one column per language

    def lookup(self) -> np.ndarray:
        place = np.full(CODES, len(self.codes), dtype=np.uint16 if len(self.codes) < 1 << 16 else np.int32)
        place[self.codes] = np.arange(len(self.codes))
        return place

    def scores(self, place: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One row of scores per text of a slice."""
        n, known = len(off) - 1, len(self.codes)
        out = np.zeros((n, len(self.languages)), dtype=np.float32)
        for a in range(0, n, ROWS):
            z = min(n, a + ROWS)
            part, at = data[off[a]:off[z]], off[a:z + 1] - off[a]
            seen = np.zeros((z - a, known + 1), dtype=np.float32)
            flat = seen.reshape(-1)
            for code, row in gram_codes(part, at):
                flat[row * (known + 1) + place[code]] = 1
            seen = seen[:, :known]
            norm = np.sqrt(np.maximum(seen.sum(axis=1), 1))
            out[a:z] = (seen @ self.weights) / norm[:, None]
        return out


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on (language, distinct n-gram codes) pairs; the first ones of each language are landmarks."""
    if not samples:
        return None
    counts: dict[str, int] = {}
    marks = []
    for i, (lang, _) in enumerate(samples):
        counts[lang] = counts.get(lang, 0) + 1
        if counts[lang] <= landmarks:
            marks.append(i)
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    codes = np.unique(np.concatenate([samples[i][1] for i in marks]))
    presence = np.zeros((len(samples), len(codes)), dtype=np.float32)
    for i, (_, own) in enumerate(samples):
        at = np.searchsorted(codes, own)
        at = at[(at < len(codes))]
        own = own[:len(at)]
        presence[i, at[codes[at] == own]] = 1
    unit = presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))
    land = unit[marks]
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = (unit @ land.T).astype(np.float64) @ whiten
    target = np.array([[float(lang == x) for x in languages] for lang, _ in samples])
    share = np.sqrt(1 / np.array([counts[lang] for lang, _ in samples]))[:, None]  # languages count alike
    a, b = features * share, target * share
    solved = np.linalg.solve(a.T @ a + ridge / len(samples) * np.eye(a.shape[1]), a.T @ b)
    return Model(languages, codes, (land.T @ (whiten @ solved)).astype(np.float32))


def _distinct_codes(batches):
    """mapInArrow over (lang, tie, text): the distinct n-gram codes of each text."""
    for batch in batches:
        for at, data, off in slices(batch.column(2)):
            lists = []
            for i in range(len(off) - 1):
                own = [c for c, _ in gram_codes(data[off[i]:off[i + 1]], np.array([0, off[i + 1] - off[i]]))]
                lists.append(np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32))
            n = len(lists)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n),
                                              pa.array(lists, pa.list_(pa.int32()))], names=["lang", "tie", "codes"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` different labelled documents per language that are not held out, in a seeded order of
    id and text; repeated rows count once and rows that only share an id are different, so ``sample`` bounds what
    reaches the driver."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                           & ~held_out(F.col("doc_id")))
    labelled = labelled.select("doc_id", "lang", "text", *text_key(F.col("text")))
    keys = ["lang", "doc_id", "k1", "k2"]
    order = Window.partitionBy("lang").orderBy("tie", "doc_id", "k1", "k2")
    chosen = (labelled.select(*keys).distinct().withColumn("tie", F.xxhash64(F.lit(5), "doc_id"))
              .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).select(*keys, "tie"))
    # At most ``sample`` rows a language, as many as the model is fitted on: the texts need no shuffle to be picked.
    rows = (labelled.join(F.broadcast(chosen), keys).dropDuplicates(keys).select("lang", "tie", "text")
            .mapInArrow(_distinct_codes, "lang string, tie long, codes array<int>").toArrow())
    picked = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), range(rows.num_rows)))
    lists = rows.column(2).combine_chunks()
    return fit([(lang, np.asarray(lists[i].values)) for lang, _, i in picked])


def predict(docs: DataFrame, model: Model | None, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of ``docs`` with the predicted language and its score added under the names given
    (they replace columns so named)."""
    names = [c for c in docs.columns if c not in (lang_pred, score)]

    def run(batches):
        place = model.lookup() if model else None
        for batch in batches:
            for at, data, off in slices(batch.column(0)):
                n = len(off) - 1
                letter = has_letter(data, off)
                if model:
                    scores = model.scores(place, data, off)
                    best = scores.argmax(axis=1)
                    top = np.clip(scores[np.arange(n), best], 0, 1).astype(np.float64)
                    known = letter
                else:
                    best, top, known = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, n) for i in range(1, batch.num_columns)),
                     pa.array(lang, pa.string()), pa.array(np.where(known, top, 0.0))],
                    names=[*batch.schema.names[1:], lang_pred, score])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    schema = ", ".join([*fields, f"{lang_pred} string", f"{score} double"])
    return docs.select(F.col("text").alias(unused(docs, "text")[0]), *names).mapInArrow(run, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on the labelled rows of ``docs`` (doc_id, text, lang) and predict every row."""
    return predict(docs, train(docs, sample))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
