import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from seedloom.llm.components import components
from seedloom.llm.jaccard import Trie, met_often, near_duplicates, one_of_each, thrice


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (component, number of linked documents); texts of one id are one document."""
    ids = sorted({k for k, t in rows if k is not None and shingles(t)})
    sets = {k: {frozenset(shingles(t)) for q, t in rows if q == k} for k in ids}
    root = {k: k for k in ids}
    link = lambda a, b: any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])
    n = dict.fromkeys(ids, 0)
    for a in ids:
        for b in ids:
            if a != b and link(a, b):
                n[a] += 1
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return {k: (root[k], n[k]) for k in ids}


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 400)
    bases = [[word() for _ in range(rng.choice([3, 6, 9, 20, 60]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [word()]
        rows.append((i * 3 + 1, " ".join(w).title() if rng.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("chunk", [1_000_000, 150])
def test_against_brute_force(spark, chunk):
    rows = [*made(1, 90), (0, None), (2, ""), (3, "one"), (5, "One"), (6, " \n "), (8, "a b c d e f g"), (9, "a b c d e f g a b c d")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, n long, prefix string").repartition(3)
    got = near_duplicates(df, chunk=chunk).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.n_shingles == len(shingles(text))
        assert (r.component_id, r.n_links) == want.get(r.doc_id, (r.doc_id, 0)), r
    left = one_of_each(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.doc_id == r.component_id}


def test_repeated_and_null_ids(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(1, long), (1, long), (4, long + " y"), (4, "other text that stands alone here"), (7, "other text that stands alone here"), (None, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("1", "1"), ("1", "1"), ("4", "1"), ("4", "1"), ("7", "1"), ("None", "None"), ("None", "None")])
    # each text is judged by itself: the second text of id 4 is no copy of the first one's group
    assert sorted(str(r.doc_id) for r in one_of_each(df).collect()) == ["1", "4", "None"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_group_whatever_the_ids(spark):
    long = lambda k: " ".join(f"x{k}y{i}" for i in range(40))
    rows = [(1, long(1)), (1, long(2)), (1, long(1)), (None, long(2)), (None, long(3) + " z"), (None, long(3)), (5, long(3)), (None, ""), (None, ""), (6, None), (7, long(4)), (7, long(5) + " q"), (3, long(5))]
    df = spark.createDataFrame([(k, t, "n", i, i % 2, {"a": i}) for i, (k, t) in enumerate(rows)], "doc_id int, text string, _node string, _gone int, component_id int, m map<string,int>").repartition(3)
    left = one_of_each(df)
    assert left.columns == df.columns
    got = left.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("1", long(1)), ("1", long(2)), ("5", long(3)), ("None", ""), ("6", ""), ("7", long(4)), ("3", long(5))])
    assert all(r._gone == next(i for i, x in enumerate(rows) if x == (r.doc_id, r.text)) for r in got if r.text == long(2))
    assert one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("fewest", [100, 700])
def test_a_dense_group_is_parted(spark, fewest):
    """5,000 near copies, of which each differs in a word or two, and texts that share a passage with them."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(5000):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 3), replace=False).tolist():
            w[k] = f"n{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    rows += [(6000 + i, " ".join(base[:60] + [f"t{i}s{k}" for k in range(60)])) for i in range(300)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), fewest=fewest).collect()
    words = {k: t.split() for k, t in rows}
    index = {}
    for w in words.values():
        for i in range(117):
            index.setdefault(tuple(w[i : i + 4]), len(index))
    m = np.zeros((len(rows), len(index)), np.float32)
    for r, w in enumerate(words.values()):
        m[r, [index[tuple(w[i : i + 4])] for i in range(117)]] = 1
    size, both = m.sum(1), m @ m.T
    link = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, False)
    n = dict(zip(words, link.sum(1).tolist()))
    assert {r.doc_id: r.n_links for r in got} == n
    root = {k: k for k in words}
    ids = list(words)
    for _ in range(20):
        low = np.where(link, np.array([root[k] for k in ids])[None, :], 1 << 40).min(1)
        root = {k: min(root[k], int(v)) for k, v in zip(ids, low)}
    assert {r.doc_id: r.component_id for r in got} == root


def test_a_tree_of_unlike_sets_is_left_early():
    """Time for sets that share nothing grows far slower than their pairs."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64)) for _ in range(8000)]
    seconds = []
    for some in (sets[:1000], sets):
        start = time.perf_counter()
        q, x = Trie(some).links(some, 85)
        seconds.append(time.perf_counter() - start)
        assert (q == x).all() and len(q) == len(some)
    assert seconds[1] < 40 * max(0.05, seconds[0])


def test_trie_finds_all():
    rng = np.random.default_rng(2)
    base = rng.choice(500, 40, replace=False)
    sets = {tuple(sorted({*base[: rng.integers(20, 41)].tolist(), *rng.choice(500, rng.integers(0, 5)).tolist()})) for _ in range(120)}
    sets = [np.array(s, np.uint64) for s in sorted(sets)]
    trie = Trie(sets)
    for q in sets:
        want = {i for i, x in enumerate(sets) if 100 * len(np.intersect1d(q, x)) >= 85 * len(np.union1d(q, x))}
        assert set(trie.linked(q, 85).tolist()) == want


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    root = {k: k for e in pairs for k in e}
    for a, b in pairs:
        lo, hi = sorted((root[a], root[b]))
        root = {k: lo if r == hi else r for k, r in root.items()}
    got = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert all(got.get(k, k) == r for k, r in root.items())


def test_shingles_met_often_are_counted_in_little_memory():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 600_000).astype(np.uint64)
    sample[::7] = sample[rng.integers(0, 20_000, len(sample[::7]))]
    u, n = np.unique(sample, return_counts=True)
    tracemalloc.start()
    found, times = thrice(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == u[n > 2]).all() and (times == n[n > 2]).all() and len(found) > 10_000
    assert peak < sample.nbytes  # np.unique holds several times that
    for few in ([], [5], [5, 5], [5, 5, 5], [7, 5, 5, 5, 5, 7, 7], [1, 1, 2, 2, 3, 3]):
        u, n = np.unique(np.array(few, np.uint64), return_counts=True)
        assert [x.tolist() for x in thrice(np.array(few, np.uint64))] == [u[n > 2].tolist(), n[n > 2].tolist()]


def test_runs_of_shingles_met_often():
    texts = ["a b c d e f", "A b c d e f", "x a b c d e f", "long " + "w%d " * 30 % tuple(range(30)), "", "a b c d e f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    count = lambda most: [dict(zip(*(c.to_pylist() for c in b.columns))) for b in met_often([batch, batch], most=most)]
    assert [sorted(x.values()) for x in count(1000)] == [[8, 8, 8]]
    assert [sorted(x.values()) for x in count(20)] == [[4, 4, 4]] * 2  # the buffer grows, and begins anew
