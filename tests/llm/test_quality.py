import math
import zlib

import numpy as np
import xxhash
import zstandard
from seedloom.llm.quality import classify, fit, fit_texts, scored

GOOD = ["the river runs along the old town and the people walk beside it in the evening", "a letter came from the coast with news about the ship and its long journey home"]


def made(n):
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(GOOD[(i + j) % 2] + f" {i * j}" for j in range(3)) if good else f"$$$ %%% {i} ### BUY!! NOW!! &&& @@@ " * 8
        docs.append((i, text, "x", 1.0))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = made(240)
    docs += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (None, "no id", "x", 0.0), (5, docs[5][1], "x", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, quality_score double").repartition(3)
    known = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    got = classify(df, known).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    flipped = known.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality")
    assert sorted((str(r.doc_id), r.score) for r in classify(df, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in classify(df, none).collect()] == [0.5, 0.5]
    assert classify(df.limit(0), none).count() == 0
    assert fit_texts([b"a"] * 9, [], 1.0).score([], [b"z"]).tolist() == [1.0]


def test_scores_from_compressed_sizes(spark):
    """Sample, sizes and curve in plain Python; only the dictionaries and the curve's weights are the model's."""
    docs, labels = made(160)
    docs += [(900, "", "x", 0.0), (901, "long text of words " * 80_000, "x", 0.0), (902, "#" * 1_000_000, "x", 0.0), (903, None, "x", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, q double").repartition(3)
    known = spark.createDataFrame([*labels, (3, 0)], "doc_id long, quality int")
    of = {k: min(q for j, q in [*labels, (3, 0)] if j == k) for k, _ in labels}
    train = [k for k in of if zlib.crc32(str(k).encode()) % 4 != 2]
    order = sorted(train, key=lambda k: np.int64(np.uint64(xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), seed=42))))
    texts = {k: t.encode() for k, t, *_ in docs if t is not None}
    picked = [[texts[k] for k in [x for x in order if of[x] == q][:30]] for q in (0, 1)]
    model = fit_texts(picked[1], picked[0], sum(of[k] for k in train) / len(train))
    got = {r.doc_id: r.quality_score for r in scored(df, fit(df, known, rows=30)).collect()}

    def size(text, dictionary):
        own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return len(zstandard.ZstdCompressor(level=3, write_content_size=False, **own).compress(text))

    for k, t, *_ in docs:
        raw = (t or "").encode()
        good, bad, none = size(raw, model.good), size(raw, model.bad), size(raw, b"")
        x = [(bad - good) / (bad + good), math.log((good + 8) / (len(raw) + 8)), math.log((min(good, bad) + 8) / (none + 8)), math.log(len(raw) + 8)]
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
        terms = [1.0, *z, *(z[i] * z[j] for i in range(4) for j in range(i, 4))]
        value = sum(a * b for a, b in zip(terms, model.weights))
        assert math.isclose(got[k], 1 / (1 + math.exp(-min(500, max(-500, value)))), rel_tol=1e-6, abs_tol=1e-9)
