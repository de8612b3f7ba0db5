"""Quality by compression: a dictionary of good text against one of bad text.

A text that compresses better with the dictionary trained on good text than
with the one trained on bad text looks good. The difference of the two sizes,
normalised by their sum, is calibrated to a probability together with the
sizes' ratio to the raw length, to the size without a dictionary, and the
length, by a logistic curve of second degree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, table

#: The most labelled rows of each class, and bytes of their texts, that a fit takes.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 16_000_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
THRESHOLD = 0.7


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: their text itself
        return b"\n".join(samples)[-size:]


def _degree_two(x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i in range(k) for j in range(i, k))])


@dataclass
class Model:
    """Dictionaries, and the curve from sizes to the probability of label 1."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    level: int = LEVEL

    def compressors(self) -> list:
        make = lambda d: zstandard.ZstdCompressor(level=self.level, write_content_size=False, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}))
        return [make(self.good), make(self.bad), make(b"")]

    @staticmethod
    def features(compressors: list, texts: list[bytes]) -> np.ndarray:
        g, b, plain = ([len(c.compress(t)) for t in texts] for c in compressors)
        g, b, plain, raw = (np.array(v, float) for v in (g, b, plain, list(map(len, texts))))
        return np.column_stack([(b - g) / (b + g), np.log((g + 8) / (raw + 8)), np.log((np.minimum(g, b) + 8) / (plain + 8)), np.log(raw + 8)])

    def score(self, compressors: list, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        z = np.clip((self.features(compressors, texts) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(_degree_two(z) @ self.weights, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method with halved steps."""

    def loss(b):
        z = x @ b
        return float(np.sum(w * (np.logaddexp(0, z) - y * z)) + ridge / 2 * b @ b)

    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope = x.T @ (w * (p - y)) + ridge * b
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), slope)
        size, now = 1.0, loss(b)
        while size > 1e-4 and loss(b - size * step) > now:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return b


def fit_texts(good: list[bytes], bad: list[bytes], share_good: float) -> Model:
    """Dictionaries from every second text of each class, the curve from the others."""
    none = np.zeros(0)
    if len(good) < 4 or len(bad) < 4:
        return Model(b"", b"", none, none, none, min(max(share_good, 0.0), 1.0))
    model = Model(_dictionary(good[::2], DICTIONARY_BYTES), _dictionary(bad[::2], DICTIONARY_BYTES), none, none, none, share_good)
    held = good[1::2] + bad[1::2]
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    w = np.where(y == 1, share_good * len(y) / y.sum(), (1 - share_good) * len(y) / (len(y) - y.sum()))
    x = model.features(model.compressors(), held)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic(_degree_two(np.clip((x - model.mean) / model.scale, -8, 8)), y, w)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(crc32_of_id(doc_id) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from a bounded sample of the labelled documents that aren't held out.

    Of each class the rows with the smallest hashes of their ids are taken, up
    to `rows` and to `most_bytes` of text. A document with both labels counts
    as bad. With fewer than four texts of a class, every score is the share of good labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(rows) for q in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * rows ids at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    texts = texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    got: list[list[bytes]] = [[], []]
    size = [0, 0]
    for r in texts.withColumn("o", order).orderBy("o", "doc_id").select("quality", "text").toLocalIterator():
        raw = r.text.encode()
        if size[r.quality] + len(raw) <= most_bytes:
            got[r.quality].append(raw)
            size[r.quality] += len(raw)
    return fit_texts(got[1], got[0], share)


def scored(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a column of scores in place of any of that name. Null text counts as empty; a text of any length is compressed whole."""
    rest = [c for c in docs.columns if c != name]
    schema = docs.select(*rest).schema.add(name, "double")
    at = rest.index("text")

    def run(batches):
        own = model.compressors()
        for b in batches:
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(own, texts), pa.float64())], [*b.schema.names, name])

    return docs.select(*rest).withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Null text is scored as an empty one, repeated rows each get a row, a null
    id is never held out, other columns are not read.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
