"""Exact substring deduplication on a compacted De Bruijn graph of word k-mers.

An edge is a window of k words; its nodes are the k - 1 words at either end.
Neighbouring edges of one document that have the same minimizer (the least hash among
the m-word spans inside) form a run, so that equal text gives equal runs whatever stands around it.
A run is one row of the edge table: minimizer, hash of all its words, number of edges, its outer nodes, coordinates.

1. Minimizers that stand in one document only are dropped with their runs.
2. Equal runs become one, with the coordinates of its first document. Where a minimizer
   has several, edges are taken one by one, from the text at these coordinates.
3. The degrees of the nodes of all repeated edges and runs tell where the graph doesn't branch. A join
   brings this to the units; in later documents units that follow one another over
   nodes that don't branch, from one place of one first document, compact to a path.
4. Each long path is verified: the words at the source's coordinates and those of the later
   document must have the same 128-bit digest. Only then they are removed.

Joins are by key with pre-aggregated sides; no row holds more than one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, ids_fit, small_batches, table, written
from .hashing import Rolled, Words, sliding_min, word_hashes
from .tokenizing import slices

K, M = 50, 18
#: Bytes of text that a worker takes out of Arrow at a time; a longer text is taken whole.
PART = 500_000
#: Fewer than other operators remember: a word that isn't costs little here, and workers hold these words all the time.
_words = Words(100_000)
#: Stands for a null id: later than all others.
_LAST = (1 << 63) - 1

PATH = "mh long, r1 long, n int, key long, tie long, start int, head long, tail long"


def _keyed(docs: DataFrame) -> DataFrame:
    """key, tie (tells rows with one id apart), doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key")
    return docs.select(key, F.xxhash64(text).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _parts(batches, column: int, size=len):
    """The batches in parts of about PART bytes of a column of texts or binaries, and these as buffers.

    Python objects and results are those of one part, not of all rows of a batch. size: the bytes of a buffer.
    """
    for b in batches:
        raw = [x.as_buffer() for x in b.column(column)]
        for i, j in slices(raw, [size(x) for x in raw], PART):
            yield b.slice(i, j - i), raw[i:j]


def _unpacked(batches, column: int):
    """The batches in parts by the size of a column's packed texts, and the words of each text, one after another."""
    unpack = zstandard.ZstdDecompressor()
    for part, raw in _parts(batches, column, zstandard.frame_content_size):
        yield part, (unpack.decompress(x).split() for x in raw)


def paths_of(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Each document's runs: PATH. start counts words, a run of n edges has n + k - 1 words, head and tail are its outer nodes."""

    def run(batches):
        for part, raw in _parts(batches, 2):
            keys, ties = part.column(0).to_numpy(), part.column(1).to_numpy()
            h, ends = word_hashes([x.to_pybytes().split() for x in raw], _words)
            if len(h) < k:
                continue
            rolled = Rolled(h)
            low = sliding_min(rolled.windows(m), k - m + 1)
            begins = np.concatenate([[0], ends[:-1]])
            whole = np.zeros(len(low) + 1, np.int64)  # edges inside one document
            for s, e in zip(begins, ends):
                if e - s >= k:
                    whole[s] += 1
                    whole[e - k + 1] -= 1
            inside = np.cumsum(whole[:-1]) > 0
            new = inside.copy()
            new[1:] &= ~(inside[:-1] & (low[1:] == low[:-1]))
            start = np.flatnonzero(new)
            stops = np.append(np.flatnonzero(new | ~inside), len(low))
            n = stops[np.searchsorted(stops, start, "right")] - start
            doc = np.searchsorted(ends, start, "right")
            whole_run, head, tail = rolled.spans(start, start + n + k - 1), rolled.spans(start, start + k - 1), rolled.spans(start + n, start + n + k - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(low[start].view(np.int64)), pa.array(whole_run.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(keys[doc]), pa.array(ties[doc]),
                    pa.array((start - begins[doc]).astype(np.int32)), pa.array(head.view(np.int64)), pa.array(tail.view(np.int64)),
                ],
                ["mh", "r1", "n", "key", "tie", "start", "head", "tail"],
            )

    return _keyed(docs).select("key", "tie", "text").mapInArrow(run, PATH)


def _packed(docs: DataFrame) -> DataFrame:
    """key, tie, doc_id, packed: texts, compressed once and written before they are shuffled."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for part, raw in _parts(batches, 3):
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([pack.compress(x) for x in raw], pa.binary())], ["key", "tie", "doc_id", "packed"])

    with small_batches(docs.sparkSession):
        return written(_keyed(docs).mapInArrow(run, "key long, tie long, doc_id long, packed binary"), "substring-texts", "none")


def _some(texts: DataFrame, only: DataFrame) -> DataFrame:
    """One of the packed texts for each of some (key, tie)."""
    return texts.join(ids_fit(only), ["key", "tie"], "left_semi").dropDuplicates(["key", "tie"])


def _single_edges(texts: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """mh, w, head, tail, r1, n, key, tie, first, at: the distinct edges of each path, one by one.

    texts: as packed; sources: key, tie, start, n, mh, r1 of paths in their first documents. w is the edge's hash, first the place of the edge in
    its document, at its places within the path.
    """

    def run(batches):
        for part, words in _unpacked(batches, 2):
            h, ends = word_hashes(list(words), _words)
            rolled = Rolled(h)
            hashes, nodes = rolled.windows(k).view(np.int64), rolled.windows(k - 1).view(np.int64)
            keys, ties, paths = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
            start, n, mh, r1 = (c.to_numpy() for c in paths.flatten().flatten())
            doc = np.repeat(np.arange(len(part)), paths.value_lengths().to_numpy())
            begin = np.concatenate([[0], ends[:-1]])[doc] + start
            path = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
            w = hashes[begin[path] + at]
            order = np.lexsort((w, path))  # stable: places stay in order
            path, at, w = path[order], at[order].astype(np.int32), w[order]
            new = np.ones(len(w), bool)
            new[1:] = (path[1:] != path[:-1]) | (w[1:] != w[:-1])
            one = np.flatnonzero(new)
            path, place = path[one], begin[path[one]] + at[one]
            lists = pa.ListArray.from_arrays(pa.array(np.append(one, len(w)).astype(np.int32)), pa.array(at))
            columns = (mh[path], w[one], nodes[place], nodes[place + 1], r1[path], n[path], keys[doc[path]], ties[doc[path]], start[path] + at[one])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["mh", "w", "head", "tail", "r1", "n", "key", "tie", "first", "at"])

    lists = sources.groupBy("key", "tie").agg(F.collect_list(F.struct("start", "n", "mh", "r1")).alias("paths"))
    rows = _some(texts, sources.select("key", "tie").distinct()).join(lists, ["key", "tie"]).select("key", "tie", "packed", "paths")
    return rows.mapInArrow(run, "mh long, w long, head long, tail long, r1 long, n int, key long, tie long, first int, at array<int>")


def unbranched(units: DataFrame) -> DataFrame:
    """node: those that one unit enters and one leaves. units: head, tail, distinct."""
    ends = units.select(F.col("tail").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")).unionByName(units.select(F.col("head").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")))
    return ends.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).filter("into = 1 AND out = 1").select("node")


def compacted(found: DataFrame) -> DataFrame:
    """key, tie, start, n, skey, stie, sstart: units of a document that follow one another over unbranched nodes, and in their source, as one path.

    found: units with their places in a later document (key, tie, start, n) and in the first one (skey, stie, sstart), and joins:
    whether the node before doesn't branch.
    """
    line = ["key", "tie", "skey", "stie", "diagonal"]
    rows = found.withColumn("diagonal", F.col("start") - F.col("sstart")).withColumn("end", F.col("start") + F.col("n"))
    before = Window.partitionBy(*line).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)) | ((F.col("start") == F.max("end").over(before)) & ~F.col("joins"))
    upto = Window.partitionBy(*line).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("apart", apart.cast("int")).withColumn("path", F.sum("apart").over(upto))
    rows = rows.groupBy(*line, "path").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return rows.select("key", "tie", "start", (F.col("end") - F.col("start")).alias("n"), "skey", "stie", (F.col("start") - F.col("diagonal")).cast("int").alias("sstart"))


def _digest(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the words, divided by a space, as two signed numbers."""
    v = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (v >> 64) - (1 << 63), (v & (1 << 64) - 1) - (1 << 63)


def _source_digests(texts: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """skey, stie, sstart, n, d1, d2: the digests of distinct spans of n edges, from the words at their coordinates."""

    def run(batches):
        for part, own_words in _unpacked(batches, 2):
            out: list[list] = [[] for _ in range(6)]
            for key, tie, own, words in zip(*(part.column(i).to_pylist() for i in (0, 1, 3)), own_words):
                for x in own:
                    for c, v in zip(out, (key, tie, x["sstart"], x["n"], *_digest(words[x["sstart"] : x["sstart"] + x["n"] + k - 1]))):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["skey", "stie", "sstart", "n", "d1", "d2"])

    distinct = spans.select(F.col("skey").alias("key"), F.col("stie").alias("tie"), "sstart", "n").distinct()
    lists = written(distinct.groupBy("key", "tie").agg(F.collect_list(F.struct("sstart", "n")).alias("own")), "substring-spans")
    rows = _some(texts, lists.select("key", "tie")).join(lists, ["key", "tie"]).select("key", "tie", "packed", "own")
    return rows.mapInArrow(run, "skey long, stie long, sstart int, n int, d1 long, d2 long")


def repeated(docs: DataFrame, k: int = K, m: int = M, texts: DataFrame | None = None) -> DataFrame:
    """key, tie, start, n, d1, d2: paths of n edges that also stand in a document with a smaller id, and the digests of the words there."""
    path = ["mh", "r1", "n"]
    texts = _packed(docs) if texts is None else texts
    with small_batches(docs.sparkSession):
        all_runs = written(paths_of(docs, k, m), "substring-runs")
    shared = all_runs.groupBy("mh").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("mh")
    runs = written(all_runs.join(shared, "mh", "left_semi"), "substring-shared")
    discard(all_runs)
    paths = runs.groupBy(*path).agg(F.min(F.struct("key", "tie", "start")).alias("first"), F.max("key").alias("last"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    paths = written(paths.select(*path, "first.*", "last", "head", "tail"), "substring-distinct")

    branching = written(paths.groupBy("mh").count().filter("count > 1").select("mh"), "substring-branching")
    sources = paths.join(branching, "mh", "left_semi").select("key", "tie", "start", "n", "mh", "r1")
    single = written(_single_edges(texts, sources, k), "substring-edges")
    edges = single.groupBy("mh", "w").agg(F.min(F.struct("key", "tie", "first")).alias("low"), F.max("key").alias("high"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    edges = written(edges.filter("low.key < high").select("mh", "w", F.col("low.key").alias("skey"), F.col("low.tie").alias("stie"), F.col("low.first").alias("sfirst"), "head", "tail"), "substring-repeated")

    # the graph of what repeats: whole paths where a minimizer has one, else single edges; a path that stands in
    # later documents as a whole is walked from end to end
    again = paths.filter("key < last").select(*path, "head", "tail", F.col("key").alias("skey"), F.col("tie").alias("stie"), F.col("start").alias("sstart"))
    whole = again.join(branching, "mh", "left_anti")
    plain = written(unbranched(whole.select("head", "tail").unionByName(edges.select("head", "tail"))), "substring-nodes")
    flagged = lambda units: units.join(plain.select(F.col("node").alias("head"), F.lit(True).alias("joins")), "head", "left").withColumn("joins", F.coalesce("joins", F.lit(False)))

    known = runs.select("key", "tie", "start", *path)
    place = ["key", "tie", "start", "n", "skey", "stie", "sstart", "joins"]
    later = known.join(flagged(again).drop("head", "tail"), path).filter("skey < key").select(*place)
    # edges that stand before the first document of their path
    parts = single.select("mh", "w", *path[1:], "key", "at").join(flagged(edges).drop("head", "tail"), ["mh", "w"]).filter("skey < key")
    parts = parts.groupBy(*path, "key").agg(F.collect_list(F.struct("at", "skey", "stie", F.col("sfirst").alias("sstart"), "joins")).alias("edges"))
    parts = known.join(parts, [*path, "key"]).select("key", "tie", "start", F.explode("edges").alias("e")).select("key", "tie", "start", F.explode("e.at").alias("at"), "e.skey", "e.stie", "e.sstart", "e.joins")
    parts = parts.select("key", "tie", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"), "skey", "stie", "sstart", "joins")
    spans = written(compacted(later.unionByName(parts)), "substring-paths")
    return spans.join(_source_digests(texts, spans, k), ["skey", "stie", "sstart", "n"]).select("key", "tie", "start", "n", "d1", "d2")


def dedup(docs: DataFrame, k: int = K, m: int = M, with_text: bool = True) -> DataFrame:
    """Each row without the words of windows that also start in a row with a smaller id.

    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), removed (spans of words, merged, end exclusive) and, if asked for, kept text.
    Null text has no words; rows of one id don't count as earlier than each other;
    null ids count as the latest; texts of fewer than k words stay whole; an empty
    table gives no rows; other columns are not read; a text of any length is taken whole.
    """
    packed = _packed(docs)
    spans = repeated(docs, k, m, packed).groupBy("key", "tie").agg(F.collect_list(F.struct("start", "n", "d1", "d2")).alias("spans"))

    def run(batches):
        for part, texts in _unpacked(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for found, words in zip(part.column(2).to_pylist(), texts):
                gone, merged = np.zeros(len(words), bool), []
                if found:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for s in found:
                        end = s["start"] + s["n"] + k - 1
                        if _digest(words[s["start"] : end]) == (s["d1"], s["d2"]):
                            cover[s["start"]] += 1
                            cover[end] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    merged = edge.reshape(-1, 2).tolist()
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                for c, v in zip(out, (len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), merged, kept.decode() if with_text else None)):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
            names = ["n_words", "n_removed", "kept_sha256", "removed", "kept"]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], ["doc_id", *names])

    rows = packed.join(spans, ["key", "tie"], "left").select("doc_id", "packed", "spans")
    out = rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<long>>, kept string")
    return out if with_text else out.drop("kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), with_text=False)
