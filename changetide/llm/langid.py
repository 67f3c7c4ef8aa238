"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three lower-cased letters and word borders, hashed into buckets and
weighted by (1 + log count) * idf, at unit length. Document frequencies cover every learning row.
The weights are fitted on a bounded sample: about max_rows over all languages, of each equally many
distinct texts with a letter, those with the smallest hashes, or all of them if there are fewer; one
at least. They are fitted by follow-the-regularised-leader with L1 and L2 penalties, so most of them
are zero; a fifth of the sample is kept back to fit the temperature that calibrates the scores, but
never all texts of a language. The same rows give the same model.

Null texts and texts without a letter get `und` with score 0, and so does everything if no row can
be learned from. Rows without language or text aren't learned from. Every language with a text to
learn from is learned; with more than max_rows of them the sample holds one text of each. Texts of
any length are read whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changetide.llm.scratch import columns_of, stored
from changetide.llm.words import slices

BITS = 14
SIZE = 1 << BITS
SLICE = 1 << 20
STEP = 512
UNKNOWN = "und"
_FACTORS = tuple(np.uint32(f) for f in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None without a letter."""
    total = None
    for at in range(0, len(text or ""), SLICE):
        piece = f" {text[at : at + SLICE].lower()} "
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        if not letter.any():
            continue
        near = letter.copy()
        near[1:] |= letter[:-1]  # of the characters between words the first stays, as a border
        near[0] = True
        codes = np.where(letter, codes, np.uint32(32))[near]
        one = codes * _FACTORS[0]
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * _FACTORS[1] + codes[1:] * _FACTORS[2]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * _FACTORS[0] + codes[2:] * _FACTORS[1]
        shift = np.uint32(32 - BITS)
        found = np.zeros(SIZE, np.int64)
        for grams in (one[codes != 32], two, three):
            grams = (grams ^ (grams >> np.uint32(16))) * _FACTORS[2]
            found += np.bincount(grams >> shift, minlength=SIZE)
        total = found if total is None else total + found
    return total


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of the buckets at, held so often."""
    weights = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((weights * weights).sum())
    return weights / norm if norm else weights


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket, language
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, found: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(found)
        return weighted(at, found[at], self.idf) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, per coordinate; the state is small sums, weights come from it."""

    def __init__(self, rows: int, classes: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z, self.n = np.zeros((rows, classes)), np.zeros((rows, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def fit(rows: list, languages: list[str], idf: np.ndarray, epochs: int, alpha: float, l1: float, l2: float) -> Model:
    """rows: (language, buckets, counts) in a fixed order. Weights are worked out when a row is visited, not kept."""
    place = {name: i for i, name in enumerate(languages)}
    data = [(place[name], at, n) for name, at, n in rows]
    heard = {d[0] for i, d in enumerate(data) if i % 5 != 4}
    kept_back = [d for i, d in enumerate(data) if i % 5 == 4 and d[0] in heard]
    learned = [d for i, d in enumerate(data) if i % 5 != 4 or d[0] not in heard]
    # the last row is the bias, always on
    state = Ftrl(SIZE + 1, len(languages), alpha, l1, l2)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(learned)):
            label, at, n = learned[i]
            state.step(np.append(at, SIZE), np.append(weighted(at, n, idf), 1.0), label)
    w = np.empty((SIZE + 1, len(languages)), np.float32)
    for i in range(0, SIZE + 1, STEP):  # in parts, as many languages make it large
        w[i : i + STEP] = state.weights(slice(i, i + STEP))
    model = Model(languages, idf.astype(np.float32), w[:SIZE], w[SIZE])
    if kept_back and len(languages) > 1:
        logits = np.stack([weighted(at, n, idf) @ model.weights[at] + model.bias for _, at, n in kept_back])
        labels = np.array([d[0] for d in kept_back])
        model.temperature = calibrated(logits, labels)
    return model


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the labels are likeliest."""

    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 400))
    return float(min(grid, key=loss))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 4000,
    epochs: int = 4,
    alpha: float = 0.5,
    l1: float = 0.02,
    l2: float = 0.01,
) -> Model:
    text = F.col(text_col).cast("string").alias("text")
    lang = F.col(lang_col).cast("string").alias("lang")
    usable = F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.where(usable).select(lang, text).withColumn("hash", F.xxhash64("text"))

    def read(batches: Iterator[pa.RecordBatch]):
        """Rows (at, n): documents by bucket, at -1 of all; and (lang, hash) of the texts with a letter."""
        seen, docs_seen = np.zeros(SIZE, np.int64), 0
        for batch in slices(batches):
            keep = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = counts(text)
                if found is not None:
                    seen += found > 0
                    docs_seen += 1
                    keep.append(i)
            held = batch.take(pa.array(keep, pa.int64()))
            none = pa.nulls(len(keep), pa.int32()), pa.nulls(len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([*none, held.column(0), held.column(2)], names=["at", "n", "lang", "hash"])
        at = np.flatnonzero(seen)
        at, n = pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], docs_seen))
        none = pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([at, n, *none], names=["at", "n", "lang", "hash"])

    # copies of a text become one row in the tasks that read them
    found = rows.mapInArrow(read, "at int, n long, lang string, hash long")
    found = stored(found.groupBy("at", "lang", "hash").agg(F.sum("n").alias("n")))
    # at most one row for each bucket comes to the driver
    df = {r["at"]: r["n"] for r in found.where("at is not null").select("at", "n").collect()}
    held = np.zeros(SIZE)
    for at, n in df.items():
        if at >= 0:
            held[at] = n
    idf = np.log((1 + df.get(-1, 0)) / (1 + held)) + 1

    place = F.pmod("hash", F.lit(2**31))
    texts = found.where("at is null").select("lang", place.alias("place"))
    by_lang = stored(texts.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")))
    many = by_lang.count()
    if not many:
        return Model([], idf, np.zeros((SIZE, 0)), np.zeros(0))
    each = max(1, max_rows // many)
    # thinned out by the hash before they are ranked, with a margin that leaves `each` of them
    thin = F.greatest(F.col("least"), F.least(F.lit(1.0), 1.3 * (each + 30) / F.col("n")) * 2**31)
    ranked = texts.join(by_lang, "lang").where(F.col("place") <= thin)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= each)
    limits = stored(ranked.groupBy("lang").agg(F.max("place").alias("limit")))
    drawn = rows.join(limits, "lang").where(place <= F.col("limit")).dropDuplicates(["hash", "lang"])

    def features(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):  # counts are as long as there are buckets
            found = [counts(t) for t in batch.column(2).to_pylist()]
            keep = [i for i, f in enumerate(found) if f is not None]
            at = [np.flatnonzero(found[i]).astype(np.int32) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    batch.column(1).take(pa.array(keep, pa.int64())),
                    pa.array(at, pa.list_(pa.int32())),
                    pa.array([found[i][a].astype(np.int32) for i, a in zip(keep, at)], pa.list_(pa.int32())),
                ],
                names=["hash", "lang", "at", "n"],
            )

    drawn = drawn.select("hash", "lang", "text").mapInArrow(features, "hash long, lang string, at array<int>, n array<int>")
    def learn(batches: Iterator[pa.RecordBatch]):
        """The model of the whole sample: weights of STEP buckets a row, as bytes."""
        data = []
        for batch in batches:
            hashes, langs, at, n = (batch.column(c) for c in ("hash", "lang", "at", "n"))
            data += [
                (hashes[i].as_py(), langs[i].as_py(), at[i].values.to_numpy(), n[i].values.to_numpy())
                for i in range(batch.num_rows)
            ]
        data = [d[1:] for d in sorted(data, key=lambda d: d[:2])]
        if not data:
            return
        model = fit(data, sorted({d[0] for d in data}), idf, epochs, alpha, l1, l2)
        for i in range(0, SIZE, STEP):
            first = [model.bias.tobytes(), model.languages] if i == 0 else [None, None]
            row = [i, model.weights[i : i + STEP].tobytes(), *first, model.temperature]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.float64()]
            names = ["at", "weights", "bias", "languages", "temperature"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    # the sample is bounded and learned from in one task, so the driver holds the model alone
    kind = "at int, weights binary, bias binary, languages array<string>, temperature double"
    parts = sorted(drawn.repartition(1).mapInArrow(learn, kind).collect(), key=lambda p: p["at"])
    if not parts:
        return Model([], idf, np.zeros((SIZE, 0)), np.zeros(0))
    languages = parts[0]["languages"]
    weights = np.frombuffer(b"".join(p["weights"] for p in parts), np.float32).reshape(SIZE, len(languages))
    bias = np.frombuffer(parts[0]["bias"], np.float32)
    return Model(languages, idf.astype(np.float32), weights, bias, parts[0]["temperature"])


def predictor(docs: DataFrame, model: Model):
    """A function of a text column: struct lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predict.asNondeterministic()


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    predict = predictor(docs, model)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return rows.select(id_col, "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, model: Model, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose language is told with some certainty."""
    predict = predictor(docs, model)
    told = docs.withColumn("__language", predict(F.col(text_col).cast("string")))
    return told.where((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= min_score)).select(columns_of(docs))
