import hashlib
from collections import Counter

import numpy as np
import xxhash
from seedloom.llm.fingerprints import Draws, compare_neighbours, fingerprints, in_order, likeness

A, B = "the cat sat on the mat and ate the rat " * 3, "a dog ran over a hill é\n" * 5
TEXTS = [A, B, "", None, A, "one", "über Straße " * 700, A + "more"]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (key, text) in enumerate(rows):
        t, n = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + n[:half]
        out.append((key, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return out


def test_neighbours(spark, monkeypatch):
    import seedloom.llm.fingerprints as f

    rows = [(3 * i, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(3)
    for size in (16_000_000, 900):  # one bucket, several
        monkeypatch.setattr(f, "BUCKET_BYTES", size)
        got = compare_neighbours(df).collect()
        assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, brute(rows)))
        by = {r.doc_id: r for r in got}
        assert by[0].fingerprint == by[12].fingerprint and by[6].fingerprint == by[9].fingerprint
        for r in got:
            assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        assert by[6].near_next == 1.0 and by[9].near_next == 0.0
    plain = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert all(plain[k] == by[k].fingerprint for k in by)


def test_ties_and_few_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d")], "doc_id long, text string")
    assert compare_neighbours(df).count() == 3
    (one,) = compare_neighbours(df.limit(1)).collect()
    assert one.near_next == 1.0
    assert compare_neighbours(df.limit(0)).count() == 0


def test_collisions_equal_generalised_jaccard():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    a = Counter({w: int(rng.integers(1, 6)) for w in words[:40]})
    b = Counter({w: int(rng.integers(1, 6)) for w in words[15:]})
    want = sum((a & b).values()) / sum((a | b).values())
    d = Draws(4000)
    x, y = d.signatures([" ".join(c.elements()) for c in (a, b)])
    assert abs(float((x == y).mean()) - want) < 0.03


def test_all_columns_against_plain_fingerprints(spark):
    """Edited texts and successors are fingerprinted apart, with repeated ids, repeated rows and long texts among them."""
    rng = np.random.default_rng(3)
    some = [" ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 80)).tolist()) for _ in range(60)]
    rows = [(int(k), t) for k, t in zip(rng.integers(0, 40, 60), some)] + [(7, some[3])] * 30 + [(None, some[4])] * 30 + [(99, "long words é " * 60_000), (100, "x" * 300_000), (101, None)]
    tie = lambda t: xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63)
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    d = Draws()
    sign = lambda t: "".join(f"{int(x):04x}" for x in d.signatures([t])[0])
    same = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64
    want = []
    for i, (key, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        own, other, following = sign(t), sign(new), sign(after)
        want.append((str(key), len(t), hashlib.sha256(new.encode()).hexdigest(), own, other, same(own, other), same(own, following)))
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, seq int, tie string").repartition(5)
    for size in (16_000_000, 2_000):
        got = [(str(r.doc_id), *tuple(r)[1:]) for r in compare_neighbours(df, size).collect()]
        assert sorted(got) == sorted(want)


def test_rows_of_one_id_lie_in_several_buckets(spark):
    df = spark.createDataFrame([(None, "the same text")] * 900 + [(5, f"text {i}") for i in range(900)], "doc_id long, text string").repartition(4)
    rows, buckets = in_order(df, 4_000)
    n = [r["count"] for r in rows.filter("not extra").groupBy("bucket").count().collect()]
    assert buckets > 20 and len(n) > 20 and max(n) < 300 and sum(n) == 1800
