"""Likelihood of a text over all of its segmentations into the pieces of a given vocabulary.

A word is a path through a lattice of pieces; its probability is the sum over
all paths of the product of piece probabilities, by a forward recursion in log
space. Piece probabilities start from the vocabulary's own scores and are
re-estimated on the training words by expectation maximisation. A word that
training text has is an arc of its own, with its discounted share of all
tokens; the discounted mass goes to the paths of pieces:

    p(word) = max(c - D, 0) / N + D * V / N * sum over paths of product p(piece)

A text's probability is the product over its words and its end. Word counts are
gathered from all training texts, without a table that must fit in one place: blocks
of documents exchange their distinct words, each one row, for counts and probabilities.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, table, written
from .tokenizing import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
#: Characters of text in a block: its distinct words fit in a task.
BLOCK = 24_000_000
#: Added to each piece's expected count.
FLOOR = 0.01
#: Words of one length that the recursion takes at once.
BATCH = 20_000


class Pieces:
    """The vocabulary's pieces; the number after the last stands for any other character."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        usable = [i for i in range(self.size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.scores = np.full(self.size + 1, -np.inf)
        self.scores[usable] = [lib.get_score(i) for i in usable]

    def start(self) -> np.ndarray:
        """Log probabilities from the vocabulary's scores, which count down by rank."""
        p = np.where(np.isfinite(self.scores), 1 / (10 - np.maximum(self.scores, -1e7)), 0)
        p[-1] = p[p > 0].min() if (p > 0).any() else 1.0
        with np.errstate(divide="ignore"):
            return np.log(p / p.sum())


_pieces: dict[str, Pieces] = {}


def pieces_of(name: str) -> Pieces:
    if name not in _pieces:
        _pieces[name] = Pieces(vocabulary_path(name))
    return _pieces[name]


def _log_sum(rows: list[np.ndarray]) -> np.ndarray:
    top = np.maximum.reduce(rows)
    total = np.zeros_like(top)
    with np.errstate(invalid="ignore"):
        for r in rows:
            total += np.exp(r - top)
    return top + np.log(total)


def word_likelihood(words: list[str], pieces: Pieces, logp: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
    """Natural log of each word's probability over all segmentations.

    Words get the vocabulary's mark of a word's beginning. A character without
    a piece costs its bytes, each of 256 alike. With `expected`, the expected
    number of uses of every piece, one occurrence of each word, is added to it.
    """
    out = np.zeros(len(words))
    by: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w) + 1].append(i)
    get, other = pieces.ids.get, len(logp) - 1
    for length, places in by.items():
        for k in range(0, len(places), BATCH):
            part = places[k : k + BATCH]
            marked = ["▁" + words[i] for i in part]
            arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            forward = [np.zeros(len(part))]
            for j in range(1, length + 1):
                ways = []
                for i in range(max(0, j - pieces.longest), j):
                    ids = np.fromiter((get(w[i:j], other) for w in marked), np.int64, len(part))
                    if j - i == 1:
                        cost = logp[ids]
                        if (new := ids == other).any():
                            cost[new] += np.log(1 / 256) * np.array([len(marked[x][i].encode()) for x in np.flatnonzero(new)])
                    elif (ids != other).any():
                        cost = np.where(ids == other, -np.inf, logp[ids])
                    else:
                        continue
                    if expected is not None:
                        arcs[i, j] = ids, cost
                    ways.append(forward[i] + cost)
                forward.append(_log_sum(ways))
            out[part] = forward[length]
            if expected is not None:
                leaving: dict[int, list[int]] = defaultdict(list)
                for i, j in arcs:
                    leaving[i].append(j)
                back = [np.zeros(0)] * length + [np.zeros(len(part))]
                for i in range(length - 1, -1, -1):
                    back[i] = _log_sum([back[j] + arcs[i, j][1] for j in leaving[i]])
                for (i, j), (ids, cost) in arcs.items():
                    expected += np.bincount(ids, np.exp(forward[i] + cost + back[j] - forward[length]), len(expected))
    return out


@dataclass
class Totals:
    """Of the training texts: tokens, distinct tokens, texts, and words seen once and twice."""

    tokens: int
    distinct: int
    texts: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return min(0.95, max(0.05, self.once / (self.once + 2 * self.twice))) if self.once else 0.5

    @property
    def end(self) -> float:
        """Probability of a text's end."""
        return self.texts / self.tokens if self.tokens else 0.5

    @property
    def spread(self) -> float:
        """Probability that goes to the paths of pieces."""
        return self.discount * (self.distinct - 1) / self.tokens if self.tokens and self.distinct > 1 else 0.5

    def base(self, count) -> np.ndarray:
        return np.log10((np.asarray(count, float) + 1) / (self.tokens + self.distinct + 1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc32_of_id(doc_id) % 7 == 2, F.lit(False))


def blocks(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows of two kinds, of one block each: a document with its bag of the block's
    word numbers, or the block's distinct words with their counts in training texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("bag", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        block, size, numbers, counts = TaskContext.get().partitionId() << 32, 0, {}, []

        def ended():
            words = pa.array([[w.decode() for w in numbers]], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), words, pa.array([counts], pa.list_(pa.int64()))], schema=schema)

        for b in batches:
            texts, held = b.column(1).to_pylist(), b.column(2).to_pylist()
            n, bags, own, at = [], [], [], 0
            for i, t in enumerate(texts):
                bag = Counter(t.encode().lower().split())
                ids = []
                for w, c in bag.items():
                    k = numbers.setdefault(w, len(counts))
                    if k == len(counts):
                        counts.append(0)
                    if not held[i]:
                        counts[k] += c
                    ids.append(k)
                bags.append(pack.compress(np.array([ids, list(bag.values())], "<u4").tobytes()))
                n.append(bag.total() + 1)
                own.append(block)
                size += len(t)
                if size >= most or i == len(texts) - 1:
                    m = i + 1 - at
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), b.column(0).slice(at, m), b.column(2).slice(at, m), pa.array(n, pa.int64()), pa.array(bags, pa.binary()), pa.nulls(m, pa.list_(pa.string())), pa.nulls(m, pa.list_(pa.int64()))], schema=schema)
                    n, bags, own, at = [], [], [], i + 1
                if size >= most:
                    yield ended()
                    block, size, numbers, counts = block + 1, 0, {}, []
        if numbers:
            yield ended()

    return rows.mapInArrow(run, "block long, doc_id long, held_out boolean, n_tokens long, bag binary, words array<string>, counts array<long>")


def _new(n: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probabilities from expected uses, and a little for every piece that had any probability."""
    n = n + np.where(np.isfinite(logp), FLOOR, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(n / n.sum())


def plain_likelihoods(counts: DataFrame, logp: np.ndarray, vocabulary: str) -> DataFrame:
    """word, c, plain: each word's log probability by the vocabulary's own weights; and piece, n: the expected uses by
    training words, one row for each piece and task. counts: word, c."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("plain", pa.float64()), ("piece", pa.int32()), ("n", pa.float64())])

    def run(batches):
        total, pieces = np.zeros(len(logp)), pieces_of(vocabulary)
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            plain = np.zeros(len(words))
            for own, expected in ((np.flatnonzero(c > 0), total), (np.flatnonzero(c <= 0), None)):
                plain[own] = word_likelihood([words[i] for i in own], pieces, logp, expected)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(plain), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.float64())], schema=schema)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.float64()), pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    return counts.select("word", "c").mapInArrow(run, "word string, c long, plain double, piece int, n double")


def _uses(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of piece, n: a number for each piece of the vocabulary at most."""
    n = np.zeros(size)
    for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        n[r.piece] = r.n
    return n


def re_estimated(words: DataFrame, logp: np.ndarray, vocabulary: str) -> np.ndarray:
    """Piece log probabilities after one more round over the distinct words."""

    def run(batches):
        total = np.zeros(len(logp))
        for b in batches:
            word_likelihood(b.column(0).to_pylist(), pieces_of(vocabulary), logp, total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

    return _new(_uses(words.select("word").mapInArrow(run, "piece int, n double"), len(logp)), logp)


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of each row.

    lattice_score is the marginal probability over all segmentations with the vocabulary's own weights, and nothing
    learned but the end of texts; score is the fitted model's. Null text is an empty one: its end is its only token. Rows with a null id
    train the model. Repeated rows count and are scored each. Without training
    text the lattice has the vocabulary's own scores.
    """
    cut = written(blocks(docs, block), "lm-blocks")
    texts = cut.filter("bag is not null").select("block", "doc_id", "held_out", "n_tokens", "bag")
    local = cut.filter("words is not null").select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("id", "w")).select("block", "id", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = written(local.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    t = texts.agg(F.count_if(~F.col("held_out")).alias("texts")).first().texts
    s = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.expr("c > 0")).alias("v"), F.count_if(F.expr("c = 1")).alias("once"), F.count_if(F.expr("c = 2")).alias("twice")).first()
    totals = Totals(s.n + t, s.v + (t > 0), t, s.once, s.twice)
    logp = pieces_of(vocabulary).start()
    plain = written(plain_likelihoods(counts, logp, vocabulary), "lm-plain")
    weighed = plain.filter("word is not null").select("word", "c", "plain")
    if s.v:
        for k in range(rounds):
            logp = _new(_uses(plain.filter("piece is not null"), len(logp)), logp) if k == 0 else re_estimated(counts.filter("c > 0"), logp, vocabulary)

    def weigh(batches):
        for b in batches:
            c = b.column(1).to_numpy(zero_copy_only=False)
            paths = word_likelihood(b.column(0).to_pylist(), pieces_of(vocabulary), logp) + np.log(totals.spread)
            arc = np.where(c > 0, np.maximum(c - totals.discount, 1e-300) / max(1, totals.tokens), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.logaddexp(np.log(arc), paths) / np.log(10)), pc.divide(b.column(2), np.log(10))], ["word", "c", "lp", "plain"])

    known = weighed.mapInArrow(weigh, "word string, c long, lp double, plain double")
    back = local.select("block", "id", "word").join(known, "word").select("block", "id", "c", "lp", "plain")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        ids = right["id"].to_numpy()
        c, lp, own = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        c[ids], lp[ids], own[ids] = right["c"].to_numpy(), right["lp"].to_numpy(), right["plain"].to_numpy()
        base = totals.base(c)
        end = float(np.log10(totals.end or 1 / (totals.tokens + totals.distinct + 1)))
        known, plain, model, lattice = [], [], [], []
        for bag in left["bag"].to_pylist():
            at, n = np.frombuffer(unpack.decompress(bag), "<u4").reshape(2, -1).astype(np.int64)
            known.append(int(n[c[at] > 0].sum()) + (totals.texts > 0))
            plain.append(float(n @ base[at]) + float(totals.base(totals.texts)))
            model.append(float(n @ lp[at]) + end)
            lattice.append(float(n @ own[at]) + end)
        m = len(known)
        return pa.table([left["doc_id"], left["held_out"], left["n_tokens"], pa.array(known, pa.int64()), pa.array([totals.tokens] * m, pa.int64()), *(pa.array(x, pa.float64()) for x in (plain, model, lattice))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"])

    own = texts.withColumnRenamed("block", "of")
    return own.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
