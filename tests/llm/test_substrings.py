import hashlib
import random
import tracemalloc

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql.classic.dataframe import DataFrame
from seedloom.llm.substrings import dedup, repeated, unbranched


def brute(rows, k):
    first = {}
    words = [(key, (t or "").encode().split()) for key, t in rows]
    order = lambda key: float("inf") if key is None else key
    for key, w in words:
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            first[s] = min(first.get(s, float("inf")), order(key))
    out = []
    for key, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < order(key):
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(key), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, k, m, parts=3):
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n int, key string").repartition(parts)
    got = dedup(df, k, m).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, k)
    for r in got:
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert sum(e - s for s, e in r.removed) == r.n_removed


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("a b c d e f g h i j k l m n o p é ü".split())
    passages = [[word() for _ in range(rng.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            w += p[a : len(p) - rng.randint(0, 4)] if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 15))]
        rows.append((rng.randint(0, 45), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(None, rows[3][1]), (None, rows[3][1]), (7, None), (8, ""), (9, "x " * 90), (10, "x " * 70 + "y"), (11, "x " * 90), (12, "y " + "x " * 40), rows[5], rows[5]]
    check(spark, rows, 8, 3)


def test_default_window_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(120))
    check(spark, [(2, text), (1, text), (3, "a " + text[:300]), (4, " ".join(text.split()[:49]))], 50, 18)
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_compaction_stops_at_branching_nodes(spark):
    """One long passage that others leave and enter: paths end at the nodes where they do, and are verified at their source."""
    base = [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(["x", *base, "y"])), (3, " ".join([*base[:25], "leaves"])), (4, " ".join(["enters", *base[40:]])), (5, " ".join([*base, *base])), (6, " ".join(base[10:50]))]
    check(spark, rows, 8, 3)
    found = repeated(spark.createDataFrame(rows, "doc_id long, text string"), 8, 3).collect()
    assert {r.key for r in found} == {2, 3, 4, 5, 6}
    for r in found:
        words = next(t for k, t in rows if k == r.key).encode().split()[r.start : r.start + r.n + 7]
        v = xxhash.xxh3_128_intdigest(b" ".join(words))
        assert (r.d1, r.d2) == ((v >> 64) - (1 << 63), (v & (1 << 64) - 1) - (1 << 63))
    # whole passages are a few paths, not an edge each
    assert sum(1 for r in found if r.key == 2) <= 6


def test_nodes_with_one_way_in_and_out(spark):
    units = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 5), (9, 3), (5, 6)], "head long, tail long")
    assert sorted(r.node for r in unbranched(units).collect()) == [2, 5]


def test_a_wrong_hash_removes_nothing(spark, monkeypatch):
    """Paths that are equal by their hashes only fail at their sources' words."""
    import seedloom.llm.substrings as substrings

    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    real = substrings._source_digests
    monkeypatch.setattr(substrings, "_source_digests", lambda docs, spans, k: real(docs, spans, k).selectExpr("skey", "stie", "sstart", "n", "d1 + 1 AS d1", "d2"))
    assert {r.doc_id: r.n_removed for r in dedup(df).collect()} == {1: 0, 2: 0}


def test_long_texts_and_many_copies(spark):
    long = " ".join(f"w{i % 30_011}" for i in range(100_000))
    rows = [(1, long), (2, long[:300_000]), (3, "- " * 100_000), (4, "- " * 3_000), (5, "x" * 1_000_000)] + [(100 + i, " ".join(f"c{k}" for k in range(90))) for i in range(300)]
    check(spark, rows, 50, 18)


def test_workers_hold_a_part_of_a_batch(spark, monkeypatch):
    """However many rows a batch has, Python objects and results are those of some of its texts."""
    runs, real = {}, DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema, *a: (runs.setdefault(schema.split()[-2], run), real(self, run, schema, *a))[1])
    text = " ".join(f"w{i}" for i in range(80))
    out = dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    assert [r.n_removed for r in sorted(out.collect())] == [0, 80]
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('aé')}{rng.randint(0, 5_000)}" for _ in range(300)) for _ in range(8_000)]
    ids = pa.array(range(len(texts)), pa.int64())
    packed = pa.array([zstandard.compress(t.encode(), 1) for t in texts])
    structs = lambda rows, **kinds: pa.array([rows] * len(texts), pa.list_(pa.struct(list(kinds.items()))))
    paths = structs([{"start": 10, "n": 60, "mh": 1, "r1": 2}, {"start": 80, "n": 40, "mh": 3, "r1": 4}], start=pa.int32(), n=pa.int32(), mh=pa.int64(), r1=pa.int64())
    own = structs([{"sstart": i, "n": 10 + i} for i in range(4)], sstart=pa.int32(), n=pa.int32())
    spans = structs([{"start": i, "n": 10 + i, "d1": 0, "d2": 0} for i in range(4)], start=pa.int32(), n=pa.int32(), d1=pa.int64(), d2=pa.int64())
    whole = sum(len(t.encode()) for t in texts)
    for last, columns in {"tail": (ids, ids, pa.array(texts)), "packed": (ids, ids, ids, pa.array(texts)), "at": (ids, ids, packed, paths), "d2": (ids, ids, packed, own), "kept": (ids, packed, spans)}.items():
        batch = pa.RecordBatch.from_arrays(list(columns), [f"c{i}" for i in range(len(columns))])
        assert sum(len(got) for got in runs[last](iter([batch.slice(0, 100)]))) >= 100  # words are remembered
        tracemalloc.start()
        assert sum(len(got) for got in runs[last](iter([batch]))) >= len(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < whole, last


def test_edges_of_paths_one_by_one(spark):
    """Paths that cross, of several documents in one part: each has its distinct edges, with all their places."""
    import seedloom.llm.substrings as substrings

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(n))) for i, n in enumerate([60, 4, 0, 90, 40])]
    taken = [(0, 3, 20, 1, 11), (0, 23, 30, 2, 12), (0, 0, 1, 3, 13), (3, 0, 87, 4, 14), (3, 10, 5, 5, 15), (4, 36, 1, 6, 16), (1, 0, 1, 7, 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    texts = substrings._packed(docs)
    tie = {r.key: r.tie for r in texts.collect()}
    sources = spark.createDataFrame([(key, tie[key], *p) for key, *p in taken], "key long, tie long, start int, n int, mh long, r1 long")
    got = substrings._single_edges(texts, substrings.written(sources, "test-sources"), 4).collect()
    words, want, edge, node = dict(rows), {}, {}, {}
    for key, start, n, mh, r1 in taken:
        w = words[key].split()
        for at in range(n):
            want.setdefault((mh, r1, n, key, tie[key], tuple(w[start + at : start + at + 4])), []).append(at)
    firsts = {(mh, at[0]): x for (mh, *_, x), at in want.items()}
    starts = {mh: start for _, start, _, mh, _ in taken}
    found = {}
    for r in got:
        x = firsts[r.mh, r.at[0]]
        found[r.mh, r.r1, r.n, r.key, r.tie, x] = r.at
        assert r.first == starts[r.mh] + r.at[0]
        assert (edge.setdefault(x, r.w), node.setdefault(x[:-1], r.head), node.setdefault(x[1:], r.tail)) == (r.w, r.head, r.tail)
    assert found == want and len(got) == len(want) and len(set(edge.values())) == len(edge) and len(set(node.values())) == len(node)


def test_batches_of_whole_texts_are_small(spark, monkeypatch):
    """Of the rows that a worker gets with whole texts; the session's own setting is left as it was."""
    import seedloom.llm.substrings as substrings

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, real = spark.conf.get(name), [], DataFrame.mapInArrow

    def counted(self, run, schema, *a):
        if "text" in self.columns:
            run = lambda batches, f=run: f(b if len(b) <= 1_000 else 1 / 0 for b in batches)
            seen.append(schema)
        return real(self, run, schema, *a)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    rows = spark.range(0, 2_500, 1, 1).selectExpr("id AS doc_id", "repeat('x y ', 30) AS text")
    assert {(r.doc_id == 0, r.n_removed) for r in substrings.dedup(rows).collect()} == {(True, 0), (False, 60)}
    assert len(seen) == 2 and spark.conf.get(name) == before
