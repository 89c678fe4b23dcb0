"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (n = 1 to 3) of the lower-cased letters
of a whole text, words framed by blanks. Inverse document frequencies cover
every learnable row. The weights are fitted by follow-the-regularised-leader
(proximal, per coordinate) with elastic-net penalties on a sample of at most
`per_language` rows of each language, chosen by hash. A temperature is then
fitted on rows of the same sample that the weights have not seen.

Cases: null text or text without letters is `und` with score 0; very long
texts are read whole, in slices; no learnable row at all makes every text
`und`; one language alone is predicted for all texts with letters; repeated
rows are treated alike; other columns are not read. lang, source and doc_id
never enter a prediction; doc_id only places rows in folds and samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import combined, text_slices
from .store import Workspace

DIM_BITS = 15
DIM = 1 << DIM_BITS
ORDERS = 3
#: Rows of each language that the classifier is fitted on, at most about.
PER_LANGUAGE = 1500
#: Code points handled at a time.
_SPAN = 1 << 20

_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, blank for all others."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low[0])
        _LETTERS = table
    return _LETTERS


_LETTERS: np.ndarray | None = None


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; empty without letters."""
    total: np.ndarray | None = None
    text = text or ""
    for at in range(0, len(text), _SPAN):
        # neighbours of the slice's edge are read twice, so no n-gram is lost
        part = text[max(0, at - (ORDERS - 1)) : at + _SPAN]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = _letter_table()[np.minimum(code, 0xFFFF)]
        beyond = code > 0xFFFF
        if beyond.any():
            low[beyond] = [c if chr(c).isalpha() else 32 for c in code[beyond].tolist()]
        if not (low != 32).any():
            continue
        low = np.concatenate([[32], low, [32]]).astype(np.uint32)
        lead = ORDERS - 1 if at else 0
        h = np.zeros(len(low), np.uint32)
        buckets = []
        for n in range(ORDERS):
            m = len(low) - n
            h = (h[:m] ^ (low[n:] + np.uint32(n))) * _MULT[n]
            h ^= h >> np.uint32(15)
            inner = low[n : n + m] != 32 if n == 0 else (low[:m] != 32) | (low[n:] != 32)
            new = np.arange(m) + n > lead
            buckets.append(h[inner & new] >> np.uint32(32 - DIM_BITS))
        seen = np.bincount(np.concatenate(buckets), minlength=DIM)
        total = seen if total is None else total + seen
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


def _vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[found]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Sparse:
    """Weights other than zero by bucket: those of bucket f are at first[f] to first[f + 1]."""

    first: np.ndarray
    language: np.ndarray
    value: np.ndarray
    classes: int

    def scores(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        start, n = self.first[found], self.first[found + 1] - self.first[found]
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.language[at], weights=self.value[at] * np.repeat(x, n), minlength=self.classes)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: Sparse | None
    bias: np.ndarray
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = ngram_counts(text)
        if not len(found) or not self.languages:
            return "und", 0.0
        p = self.probabilities(self.weights.scores(found, _vector(found, counts, self.idf)) + self.bias)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3) -> tuple[Sparse, np.ndarray]:
    """Weights, most of them zero, and biases. Rows are (buckets, values)."""
    z = np.zeros((DIM + 1, classes))
    n = np.zeros((DIM + 1, classes))
    order = np.random.Generator(np.random.PCG64(7))

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            found, x = rows[i]
            at = np.append(found, DIM)
            value = np.append(x, 1.0)
            w = weights(at)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = value[:, None] * p
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    sizes, language, value = [], [], []
    for at in range(0, DIM, 1024):
        w = weights(np.arange(at, min(DIM, at + 1024)))
        some = w != 0
        sizes.append(some.sum(axis=1))
        language.append(np.nonzero(some)[1].astype(np.int32))
        value.append(w[some])
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return Sparse(first, np.concatenate(language), np.concatenate(value), classes), weights(np.array([DIM]))[0]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    low, high, ratio = -0.7, 2.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in text_slices(batches):
        for text in combined(batch, "text").to_pylist():
            found, _ = ngram_counts(text)
            df[found] += 1
            n += 1
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(found, -1), pa.int64()), pa.array(np.append(df[found], n), pa.int64())], ["feature", "n"]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = [ngram_counts(t) for t in combined(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("_order"),
                pa.array([f.astype("<u2").tobytes() for f, _ in rows], pa.binary()),
                pa.array([c.astype("<u4").tobytes() for _, c in rows], pa.binary()),
            ],
            ["lang", "_order", "found", "counts"],
        )


def train(spark: SparkSession, rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """rows: doc_id, text, lang of learnable documents."""
    ws = Workspace(spark, "language")
    rows = rows.where("lang IS NOT NULL")
    table = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = table.column("feature").to_numpy(), table.column("n").to_numpy()
    documents = int(n[feature == -1].sum())
    df = np.zeros(DIM)
    df[feature[feature >= 0]] = n[feature >= 0]
    idf = np.log((1 + documents) / (1 + df)) + 1
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], idf, None, np.zeros(1), 1.0)
    # a share of each language by hash, so that about per_language of its rows are drawn
    share = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    order = F.md5(F.concat(F.lit("language:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    drawn = rows.withColumn("_order", order).join(F.broadcast(share), "lang")
    position = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = drawn.where(position < F.col("share")).select("lang", "_order", "text")
    sample = ws.put(drawn.mapInArrow(_features, "lang string, _order string, found binary, counts binary"), "sample")
    got = sample.orderBy("_order", "lang", "found").limit(int(1.3 * per_language + 200) * len(languages)).toArrow().to_pylist()
    ws.drop(sample)
    number = {x: k for k, x in enumerate(languages)}
    vectors, labels = [], []
    for r in got:
        found = np.frombuffer(r["found"], "<u2").astype(np.int64)
        if len(found):
            vectors.append((found, _vector(found, np.frombuffer(r["counts"], "<u4").astype(float), idf)))
            labels.append(number[r["lang"]])
    y = np.array(labels, np.int64)
    # every fifth row of a language, so that rare ones are learned too
    turn, held = np.zeros(len(languages), np.int64), np.zeros(len(y), bool)
    for k, c in enumerate(labels):
        turn[c] += 1
        held[k] = turn[c] % 5 == 0
    fit_rows = [v for v, h in zip(vectors, held, strict=True) if not h]
    weights, bias = fit_ftrl(fit_rows, y[~held], len(languages))
    logits = np.array([weights.scores(f, x) + bias for (f, x), h in zip(vectors, held, strict=True) if h]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, y[held]))


def _predictor(model, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in text_slices(batches):
            found = [m.predict(t) for t in combined(batch, "text").to_pylist()]
            names = [c for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                [*names, *added],
            )

    return run


def identify(
    spark: SparkSession, docs: DataFrame, learnable: Column, *, columns: list[str] | None = None, per_language: int = PER_LANGUAGE, added: tuple[str, str] = ("lang_pred", "lang_score")
) -> DataFrame:
    """The given columns (text among them) with the predicted language and its score, which replace columns of the names `added`.

    Learns from rows where `learnable` holds."""
    from pyspark.sql import types as T

    model = spark.sparkContext.broadcast(train(spark, docs.where(learnable).select("doc_id", "text", "lang"), per_language))
    taken = {c.lower() for c in added}
    kept = docs.select(*[c for c in columns or docs.columns if c.lower() not in taken])
    schema = T.StructType([*kept.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return kept.mapInArrow(_predictor(model, list(added)), schema)


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op7_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold(4) == 2
    out = identify(spark, docs, ~held, columns=["doc_id", "text"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
