"""Token counts without ids: pieces once per distinct pre-token, times its frequency.

The count of a pre-token's pieces is a function of the pre-token alone. Texts are cut
into pre-tokens, block of documents by block; a document becomes a bag of the block's
pre-token numbers with their frequencies, and a block lists its distinct pre-tokens.
The blocks' pre-tokens meet by value: each distinct one of the corpus is encoded once,
its count goes back to all blocks that have it, and is summed over their bags. What moves is a row for each block and
distinct pre-token, not one for each document and pre-token, and no ids are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokenizing import PreTokens, kept, tokenizer, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of text in a block: its distinct pre-tokens fit in a task.
BLOCK = 48_000_000
#: More than a block has pre-tokens, and blocks that a task has at most.
PLACES, BLOCKS = 1 << 28, 1 << 14
#: Pre-tokens that are encoded at once, and rows whose numbers go back together.
BATCH, HELD = 20_000, 1_000_000


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all their low bytes first: small numbers compress to little."""
    return np.ascontiguousarray(numbers.astype("<u4").reshape(-1, 1).view(np.uint8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def packed_bag(numbers: Sequence[int], counts: Sequence[int], pack) -> bytes:
    """A bag of distinct numbers and their counts, in order of the numbers, as differences."""
    n, c = np.array(numbers, np.int64), np.array(counts, np.int64)
    order = np.argsort(n)
    return pack.compress(_planes(np.concatenate([np.diff(n[order], prepend=0), c[order]])))


def unpacked_bag(raw: bytes, unpack) -> tuple[np.ndarray, np.ndarray]:
    both = _from_planes(unpack.decompress(raw))
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def blocks(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = BLOCK) -> DataFrame:
    """Rows of two kinds, of one block each: a document with its bag of the block's pre-token numbers
    and the number of its special strings, or the block's distinct pre-tokens."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("special", pa.int64()), ("bag", pa.binary()), ("pieces", pa.list_(pa.string()))])

    def run(batches):
        cut = kept(PreTokens, vocabulary_path(vocabulary))
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        block, size, numbers = TaskContext.get().partitionId() * BLOCKS, 0, {}

        def ended():
            return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([list(numbers)], pa.list_(pa.string()))], schema=schema)

        for b in batches:
            texts = b.column(1).to_pylist()
            special, bags, own, at = [], [], [], 0
            for i, t in enumerate(texts):
                pieces, n = cut.of(t)
                bag = Counter(pieces)
                bags.append(packed_bag([numbers.setdefault(p, len(numbers)) for p in bag], list(bag.values()), pack))
                special.append(n)
                own.append(block)
                size += len(t)
                if size >= most or i == len(texts) - 1:
                    m = i + 1 - at
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), b.column(0).slice(at, m), b.column(2).slice(at, m), pa.array(special, pa.int64()), pa.array(bags, pa.binary()), pa.nulls(m, pa.list_(pa.string()))], schema=schema)
                    special, bags, own, at = [], [], [], i + 1
                if size >= most:
                    yield ended()
                    block, size, numbers = block + 1, 0, {}
        if numbers:
            yield ended()

    return rows.mapInArrow(run, "block long, doc_id long, n_bytes long, special long, bag binary, pieces array<string>")


def piece_counts(local: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """block, counts: bags of pre-token numbers of a block with their numbers of tokens, from rows (place, piece).

    Rows meet by pre-token, in order, so each distinct one of the corpus is encoded once, and its number goes
    to all blocks that have it. A pre-token of many texts has a row for each block, however often it stands there.
    """

    def packed(places: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1)
        place, n = np.concatenate(places), np.concatenate(counts)
        order = np.argsort(place)
        place, n = place[order], n[order]
        block, first = np.unique(place // PLACES, return_index=True)
        bags = [packed_bag(i, c, pack) for i, c in zip(np.split(place % PLACES, first[1:]), np.split(n, first[1:]))]
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(bags, pa.binary())], ["block", "counts"])

    def run(batches):
        lib = tokenizer(vocabulary_path(vocabulary))
        last, count, places, counts, held = None, 0, [], [], 0
        for b in batches:
            distinct = b.column(1).dictionary_encode()
            pieces, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy()
            new = pieces[1:] if pieces and pieces[0] == last else pieces
            known = [len(e) for k in range(0, len(new), BATCH) for e in lib.encode_batch_fast(new[k : k + BATCH], add_special_tokens=False)]
            n = np.array([count] * (len(pieces) - len(new)) + known, np.int64)
            if pieces:
                last, count = pieces[-1], int(n[-1])
            places.append(b.column(0).to_numpy())
            counts.append(n[at])
            held += b.num_rows
            if held >= HELD:
                yield packed(places, counts)
                places, counts, held = [], [], 0
        if held:
            yield packed(places, counts)

    return local.repartition("piece").sortWithinPartitions("piece").select("place", "piece").mapInArrow(run, "block long, counts binary")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row.

    Null text counts as empty: no bytes, no tokens. Repeated rows and null ids
    give a row each; an empty table gives none; other columns are not read; special strings are a token each.
    A text stays whole in its block, however long. Vocabularies whose pre-tokens aren't known here are refused.
    """
    PreTokens(vocabulary_path(vocabulary))
    cut = written(blocks(docs, vocabulary, block), "token-blocks")
    texts = cut.filter("bag is not null").select(F.col("block").alias("of"), "doc_id", "n_bytes", "special", "bag")
    # one number for a block and the pre-token's place in it: rows that move are few bytes
    local = cut.filter("pieces is not null").select("block", F.posexplode("pieces").alias("id", "piece")).select((F.col("block") * PLACES + F.col("id")).alias("place"), "piece")
    known = piece_counts(local, vocabulary)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        parts = [unpacked_bag(x, unpack) for x in right["counts"].to_pylist()]
        n = np.zeros(sum(len(x) for x, _ in parts), np.int64)
        for ids, own in parts:
            n[ids] = own
        sums = []
        for bag, special in zip(left["bag"].to_pylist(), left["special"].to_pylist()):
            at, times = unpacked_bag(bag, unpack)
            sums.append(special + int(n[at] @ times))
        return pa.table([left["doc_id"], left["n_bytes"], pa.array(sums, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = texts.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
