"""Concatenate and cut: documents into sequences of a fixed number of tokens.

Pass one encodes each document, and notes where its ids begin within its
partition. The partitions' totals, one row each, are summed up to global
offsets. Pass two cuts every document at the multiples of the sequence length
and yields one boundary record for each piece; no row is shuffled in it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ids_fit, table, written
from .tokenizing import WordIds, kept, slices, tokenizer, vocabulary_path

LENGTH = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """part, part_start, doc_id, n_tokens, ids (packed little-endian) of each row.

    part is the task's number; part_start counts the ids before the document
    in its task, in the order in which the task reads its rows.
    """

    def run(batches):
        words = kept(WordIds, vocabulary_path(vocabulary))
        end = np.array([end_id], f"<u{2 if words.code == 'H' else 4}").tobytes()
        width, part, at = len(end), TaskContext.get().partitionId(), 0
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            texts = [t or "" for t in texts]
            for i, j in slices(texts, [len(t) for t in texts]):
                ids = [x + end for x in words.of(texts[i:j])]
                n = np.array([len(x) // width for x in ids], np.int64)
                starts = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), keys.slice(i, j - i), pa.array(n), pa.array(ids, pa.binary())],
                    ["part", "part_start", "doc_id", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, part_start long, doc_id long, n_tokens long, ids binary")


def offsets(parts: DataFrame) -> DataFrame:
    """part, part_offset: ids in all parts before it. One row per part: a task of the first pass."""
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: PIECES.

    Null text is an empty one, which still has its end id. Repeated rows are
    packed each; null ids stay null. An empty table gives no pieces. Other
    columns are not read. Only the last sequence can be short. A text of any length is encoded whole.
    Vocabularies of which the ids of a text aren't those of its words are refused.
    """
    WordIds(vocabulary_path(vocabulary))
    tokens = written(encoded(docs, vocabulary, end_id), "packing")
    # a row for each task of the first pass: a few bytes for each input split
    parts = ids_fit(written(offsets(tokens.select("part", "n_tokens")), "packing-offsets"))
    placed = tokens.join(parts, "part")
    placed = placed.select("doc_id", (F.col("part_start") + F.col("part_offset")).alias("at"), "n_tokens", "ids")

    def run(batches):
        kind = "<u2" if tokenizer(vocabulary_path(vocabulary)).get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for key, at, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                raw = np.frombuffer(ids.as_buffer(), kind).astype("<u4").tobytes()
                done = 0
                while done < n:
                    take = min(n - done, length - (at + done) % length)
                    crc = zlib.crc32(raw[4 * done : 4 * (done + take)])
                    for c, v in zip(out, (key, done, take, crc, n, (at + done) // length, (at + done) % length)):
                        c.append(v)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
