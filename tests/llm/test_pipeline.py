import corpus_pipeline
import pytest
from seedloom.llm.common import written


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture
def corpus(spark, tmp_path):
    words = "the river town people walk letter coast ship news journey home old evening long side way small great".split()
    text = lambda s, n: " ".join(words[(s * 7 + i * i + s * i) % len(words)] + str((s * i) % 13) for i in range(n))
    docs = [(i, text(i, 60), "en", "s", 0) for i in range(60)]
    docs += [(100 + i, f"$$$ {i} ### BUY!! &&& " * 12, "en", "s", 0) for i in range(30)]
    docs += [(200, docs[3][1], "en", "s", 0), (201, docs[4][1] + " extra", "en", "s", 0), (202, docs[5][1] + " " + text(777, 20), "en", "s", 0)]
    docs += [(203, docs[6][1].replace("0", "9")[:200] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "s", 0), (204, None, "en", "s", 0), (205, "", "en", "s", 0)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, text(777, 20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, corpus), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys(), name
        seen.append((before, after))
    (b, a), *_ = seen
    assert not any(100 <= k < 130 for k in a) and set(range(60)) <= a.keys()
    b, a = seen[1]
    sets = {k: shingles(r.text) for k, r in b.items()}
    twin = {k for k in b if any(j < k and sets[j] and 100 * len(sets[j] & sets[k]) >= 80 * len(sets[j] | sets[k]) for j in b)}
    assert b.keys() - a.keys() == twin and {200, 201} <= twin
    b, a = seen[2]
    assert b.keys() - a.keys() == {202}
    b, a = seen[3]
    assert b.keys() == a.keys()
    changed = {k for k in a if a[k].text != b[k].text}
    assert changed == ({203} & a.keys())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    assert {p.doc_id for p in pieces} == a.keys()


def test_run(spark, corpus):
    got = corpus_pipeline.run(spark, corpus)
    assert got.filter("length < 1").count() == 0 and got.filter("doc_id = 1").count() >= 1


EXTRA = "_id int, _tie int, _node string, _gone string, _blob string, _found int, _score double, quality_score double, start int, item_id int, block int, m map<string,int>"
CELLS = (1, 2, "n", "g", "b", 3, 0.5, 0.25, 4, 5, 6, {"k": 1})


def test_stages_take_any_rows(spark, corpus, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows, extra columns whose names the stages might use."""
    base = {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").first().text
    secret = ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" '
    long = " ".join(f"{w}{i}" for i in range(20_000) for w in ("river", "town", "old"))
    rows = [(1, base[1]), (1, base[2]), (1, base[1]), (None, base[2]), (None, base[3]), (None, base[3]), (4, None), (4, None), (5, ""), (6, long), (6, "- " * 100_000), (7, long + " more"), (8, base[8] + " " + item), (None, base[9] + secret), (8, base[8])]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, *CELLS) for k, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(tuple(r)[5:] == CELLS for r in got), name
        after[name] = sorted((str(r.doc_id), str(r.text)) for r in got)
    every = sorted((str(k), str(t)) for k, t in rows)
    scores = {}
    for k, t in after["quality classifier"]:
        scores[k, t] = scores.get((k, t), 0) + 1
    assert all(n == every.count(x) for x, n in scores.items())  # rows of one text stay or go together
    want = [(1, base[1]), (1, base[2]), (None, base[3]), (4, None), (5, ""), (6, long), (6, "- " * 100_000), (8, base[8] + " " + item), (None, base[9] + secret), (8, base[8])]
    texts = [set(zip(*([w := (t or "").split()] and [w[i:] for i in range(5)]))) for _, t in want]
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(texts) for b in texts[:i])
    assert after["n-gram Jaccard join"] == sorted((str(k), str(t)) for k, t in want)
    assert after["benchmark decontamination"] == sorted(x for x in every if item not in x[1])
    assert after["secret scans"] == sorted((k, t.replace(secret, ' [REDACTED]" ')) for k, t in every)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    assert sum(p.length for p in pieces if p.start == 0 and p.doc_tokens == 1) == 3


def test_stages_take_no_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name


def test_run_over_an_empty_table(spark, corpus, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
