"""Document fingerprints by consistent weighted sampling.

Each term of a text (a word, A-Z lowered) weighs as often as it stands there.
Sample k of a weighted set draws r and c from Gamma(2, 1) and beta from [0, 1)
for each term, quantises the logarithm of its weight to t = floor(ln w / r + beta),
and keeps the term and t with the least ln c - r (t - beta + 1). Two sets agree in a
sample with the probability sum(min(w)) / sum(max(w)), the generalised Jaccard similarity.
All draws come from a hash of the term, so they are the same in every task.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokenizing import slices

SAMPLES = 64
#: Entries that a worker process keeps of terms that stand once, and of (term, count) pairs.
ONCE, OFTEN = 300_000, 80_000
#: Bytes of text for each bucket of the ordered pass, and the most buckets: their limits are kept in each task. Buckets are read as streams.
BUCKET_BYTES, MOST_BUCKETS = 16_000_000, 100_000
#: Rows that are looked at for each bucket to find its limits.
LOOKS = 20
_SMALLEST = -(1 << 63)

_U = np.uint64


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, modulo 2**64."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class Draws:
    """ln a of each sample for (term, weight) keys, in tables of bounded size."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.steps = (np.arange(5 * samples, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.value = np.empty((0, self.samples), np.float32)
        self.mark = np.empty((0, self.samples), np.uint16)
        self.index2: dict = {}
        self.value2 = np.empty((0, self.samples), np.float32)
        self.mark2 = np.empty((0, self.samples), np.uint16)

    def made(self, terms: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a, and 16 bits that stand for the term and its t (never 0)."""
        ids = np.array([xxhash.xxh3_64_intdigest(t) for t in terms], _U)
        u = ((_mix(ids[:, None] + self.steps[None, :]) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        u = u.reshape(len(terms), 5, self.samples)
        r, c, beta = -np.log(u[:, 0] * u[:, 1]), -np.log(u[:, 2] * u[:, 3]), u[:, 4]
        t = np.floor(np.log(weights)[:, None] / r + beta)
        value = np.log(c) - r * (t - beta + 1)
        seen = _mix(ids[:, None] + _U(0x632BE59BD9B4E019) * t.astype(np.int64).astype(_U))
        return value.astype(np.float32), (seen % _U(65535) + _U(1)).astype(np.uint16)

    def add(self, once: list[bytes], often: list[tuple[bytes, int]]) -> None:
        for keys, index, name, most in ((once, self.index, "", ONCE), (often, self.index2, "2", OFTEN)):
            if not keys:
                continue
            v, m = getattr(self, f"value{name}"), getattr(self, f"mark{name}")
            need = len(index) + len(keys)
            if need > len(v):
                size = max(need, min(most, 2 * len(v)), 1024)
                v, m = (np.concatenate([x[: len(index)], np.empty((size - len(index), self.samples), x.dtype)]) for x in (v, m))
                setattr(self, f"value{name}", v)
                setattr(self, f"mark{name}", m)
            for k in range(0, len(keys), 4096):
                part = keys[k : k + 4096]
                at = len(index)
                terms, weights = (part, np.ones(len(part))) if name == "" else ([t for t, _ in part], np.array([w for _, w in part], float))
                v[at : at + len(part)], m[at : at + len(part)] = self.made(terms, weights)
                index.update(zip(part, range(at, at + len(part))))

    def signatures(self, texts: list[str]) -> np.ndarray:
        """A row of 16-bit samples for each text; zeros for a text without words."""
        bags = [Counter(t.encode().lower().split()) for t in texts]
        once = [[t for t, n in bag.items() if n == 1] for bag in bags]
        often = [[x for x in bag.items() if x[1] > 1] for bag in bags]
        want, want2 = set().union(*once), set().union(*often)
        if len(self.index) + len(want) > ONCE or len(self.index2) + len(want2) > OFTEN:
            self.clear()
        self.add([t for t in want if t not in self.index], [x for x in want2 if x not in self.index2])
        out = np.zeros((len(texts), self.samples), np.uint16)
        k = np.arange(self.samples)
        for i, (a, b) in enumerate(zip(once, often)):
            best = None
            for keys, index, values, marks in ((a, self.index, self.value, self.mark), (b, self.index2, self.value2, self.mark2)):
                if keys:
                    rows = np.fromiter(map(index.__getitem__, keys), np.int64, len(keys))
                    v = values[rows]
                    arg = v.argmin(0)
                    low, mark = v[arg, k], marks[rows[arg], k]
                    if best is None:
                        best, out[i] = low, mark
                    else:
                        out[i] = np.where(low < best, mark, out[i])
        return out


_draws: list[Draws] = []


def draws() -> Draws:
    if not _draws:
        _draws.append(Draws())
    return _draws[0]


def shown(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row: no shuffle. Null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = []
            for i, j in slices(texts, [len(t) + 50 for t in texts], 2_000_000):
                out += [shown(r) for r in draws().signatures(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints."""
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def in_order(docs: DataFrame, bucket_bytes: int | None = None) -> tuple[DataFrame, int]:
    """bucket, extra, key, tie, seq, doc_id, packed text: buckets of neighbouring rows, and their number.

    Rows go by (key, tie, seq): the id, a hash of the text, and the row's place in the input, so that rows that
    share an id, or are equal, need not lie in one bucket. The first row of each bucket is also in the bucket before it, as `extra`
    (the first of all in the last one), so a sorted bucket knows the successor of each of its rows.
    The limits between buckets come from some rows of each, evenly by bytes; they only change where the work is done.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_SMALLEST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 100), F.lit(0))).first()[0]
    buckets = int(min(MOST_BUCKETS, 1 + n_bytes // (bucket_bytes or BUCKET_BYTES)))
    step = max(1, n_bytes // (buckets * LOOKS))

    def placed(batches):
        """Keys, ties, numbers of rows, and raw texts, batch by batch."""
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            raw = [t.encode() for t in b.column(2).to_pylist()]
            yield b, b.column(0).to_pylist(), [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in raw], list(range(first, first + len(raw))), raw
            first += len(raw)

    def looked(batches):
        size = 0
        for _, keys, ties, seqs, raw in placed(batches):
            ends = size + np.cumsum([len(t) + 100 for t in raw]) if raw else np.zeros(0, np.int64)
            some = np.flatnonzero(ends // step != np.concatenate([[size], ends[:-1]]) // step).tolist()
            size = int(ends[-1]) if len(ends) else size
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in some], pa.int64()) for x in (keys, ties, seqs)], ["key", "tie", "seq"])

    limits: list[tuple[int, int, int]] = []
    if buckets > 1:
        # at most LOOKS rows for each bucket, and one for each input split
        found = sorted(map(tuple, rows.mapInArrow(looked, "key long, tie long, seq long").collect()))
        limits = sorted({found[len(found) * i // buckets] for i in range(1, buckets)}) if found else []

    def smallest(batches):
        low: dict[int, tuple] = {}
        for _, *own in placed(batches):
            for row in zip(*own[:3]):
                at = bisect.bisect_right(limits, row)
                if at not in low or row < low[at]:
                    low[at] = row
        yield pa.RecordBatch.from_arrays([pa.array(low.keys(), pa.int32()), *(pa.array([v[i] for v in low.values()], pa.int64()) for i in range(3))], ["bucket", "key", "tie", "seq"])

    lowest = rows.mapInArrow(smallest, "bucket int, key long, tie long, seq long").groupBy("bucket").agg(F.min(F.struct("key", "tie", "seq")).alias("low")).collect()
    firsts = sorted((r.bucket, tuple(r.low)) for r in lowest)
    before = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}

    def dealt(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b, keys, ties, seqs, raw in placed(batches):
            packed = [pack.compress(t) for t in raw]
            own = list(zip(keys, ties, seqs))
            more = [i for i, row in enumerate(own) if row in before]
            out = [*range(len(raw)), *more]
            where = [bisect.bisect_right(limits, row) for row in own] + [before[own[i]] for i in more]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where, pa.int32()), pa.array([False] * len(raw) + [True] * len(more)), *(pa.array([x[i] for i in out], pa.int64()) for x in (keys, ties, seqs)),
                    b.column(1).take(pa.array(out, pa.int64())), pa.array([packed[i] for i in out], pa.binary()),
                ],
                ["bucket", "extra", "key", "tie", "seq", "doc_id", "packed"],
            )

    return rows.mapInArrow(dealt, "bucket int, extra boolean, key long, tie long, seq long, doc_id long, packed binary"), len(limits) + 1


def edited(text: str, after: str) -> str:
    """The last half of text, in code points, replaced by the beginning of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_neighbours(docs: DataFrame, bucket_bytes: int | None = None) -> DataFrame:
    """Each row's fingerprint, its edited text's, and their likeness to it and its successor's.

    Successors go by ascending doc_id; rows with one id are ordered by their
    texts' hashes, null ids come first, a lone row follows itself. Null text
    counts as empty; texts without words have a fingerprint of zeros and are alike.
    A text of any length is taken whole; an empty table gives no rows; other columns are not read.
    """
    rows, buckets = in_order(docs, bucket_bytes)
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "extra", "key", "tie", "seq")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        last = None  # bucket, doc_id, text, signature of the row whose successor isn't known yet
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 1, 5, 6)]
            for i, j in slices(cols[3], [3 * len(x) + 50 for x in cols[3]], 2_000_000):
                texts = [unpack.decompress(x).decode() for x in cols[3][i:j]]
                marks = draws().signatures(texts)
                pairs = []
                for bucket, extra, key, text, mark in zip(cols[0][i:j], cols[1][i:j], cols[2][i:j], texts, marks):
                    if last is not None and last[0] == bucket:
                        pairs.append((*last[1:], text, mark))
                    last = None if extra else (bucket, key, text, mark)
                if not pairs:
                    continue
                new = [edited(p[1], p[3]) for p in pairs]
                fresh = draws().signatures(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                        pa.array([shown(p[2]) for p in pairs]), pa.array([shown(f) for f in fresh]),
                        pa.array([float((p[2] == f).mean()) for p, f in zip(pairs, fresh)]), pa.array([float((p[2] == p[4]).mean()) for p in pairs]),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
