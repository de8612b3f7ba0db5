import random

from seedloom.llm.decontamination import contaminated, decontaminate, op2_decontamination

ITEM = "A farmer has 12 cows and sells them to Maria for 300 dollars each so how much does Maria pay him in total for all the 12 cows"


def flagged(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 3, "h") for i, t in enumerate(texts)], "doc_id long, text string, item_id int, h string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}, docs, bench


def test_copies_templates_and_slots(spark):
    around = "some other words stand here before it and more words come after "
    renamed = ITEM.replace("12", "57").replace("Maria", "Oscar").replace("300", "1,250").replace("dollars", "euros")
    torn = ITEM.replace("12 cows and", "57 cows and").replace("Maria for", "Oscar for").replace("Maria pay", "Peter pay")
    texts = [
        around + ITEM + ". " + around,
        around + renamed + " " + around,
        around * 3,
        None,
        "",
        ITEM.upper().lower().replace(" ", "\n"),
        "A farmer has 12 cows and a dog " + around,
        around + "Ann Bob Cid Dan Eve Fay Gus Hal Ian Joe Kim Lee 1 2 3 4 5 6",
        around + torn,
    ]
    got, docs, bench = flagged(spark, texts, [(7, ITEM), (8, "two words"), (9, None), (None, around)])
    assert {k for k in got} >= {(0, 7), (1, 7)} and not {d for d, _ in got} & {2, 3, 4, 6, 7}
    assert not got[0, 7].reparameterised and got[1, 7].reparameterised
    assert got[1, 7].containment == 1.0
    assert (8, 7) not in got or got[8, 7].n_found < got[1, 7].n_found
    left = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate(docs, bench).columns == docs.columns


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [a + b for a in "bdfg" for b in "aeiou"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 20)))) for i in range(12)]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        own = rng.choice(items)[1].split()
        a = rng.randint(0, len(own) // 2)
        texts.append(" ".join(w[:9] + own[a:] + w[9:]))
    got, *_ = flagged(spark, texts, items)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            g = grams(item)
            if g and len(g & grams(t)) / len(g) >= 0.5:
                want[d, i] = len(g & grams(t))
    assert {k: r.n_found for k, r in got.items()} == want


def test_repeated_ids_and_no_rows(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(5, ITEM), (5, "clean words only here"), (5, ITEM), (None, ITEM)], "doc_id long, text string")
    assert [r.text for r in decontaminate(docs, bench).collect()] == ["clean words only here"]
    assert contaminated(docs, bench).count() == 2
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_verbatim_copies_of_numbers_names_short_and_other_case(spark, tmp_path):
    items = ["What is 12 + 7 * 3 - 4 / 2 ?", "Present were Ann Bell, Bob Cole, Cid Dorn, Eve Farr, Gus Hall", "Define marginal utility", "Then Maria Lopez and Oscar Stone of Grand Rapids met Peter Quill there"]
    around = "some words before it {} and more words after"
    texts = [around.format(f(t)) for t in items for f in (str, str.lower, str.upper)] + [around.format("What is 13 + 8 * 4 - 5 / 3 ?"), around.format("define utility marginal")]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op2_decontamination(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d // 3) for d in range(12)}
    assert all(r.containment == 1.0 and not r.reparameterised for r in got)
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == {12, 13}


def judged(df):
    return sorted((str(r.doc_id), r.item_id, r.n_found, r.n_windows, r.containment, r.reparameterised) for r in df.collect())


def test_a_large_benchmark_gives_the_same(spark):
    rng = random.Random(12)
    vocab = "cows sells each Maria Oscar 12 57 300 km pays him total how much does then for".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 15)))) for i in range(25)] + [(90, ITEM), (91, "one"), (92, None), (None, ITEM)]
    texts = [None, "", ITEM, ITEM.replace("12", "9")] + [" ".join(rng.choice(vocab) for _ in range(40)) + " " + rng.choice(items[:25])[1] for _ in range(50)]
    docs = spark.createDataFrame([*enumerate(texts), (None, ITEM), (2, "other")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    small, large = (judged(contaminated(docs, bench, shortest=1, most_broadcast=n)) for n in (1 << 40, 0))
    assert small == large and len(small) > 40
    assert contaminated(docs, bench.limit(0), most_broadcast=-1).count() == 0


def test_long_texts_of_marks_and_long_words(spark):
    marks = ["- " * 100_000, "-" * 1_000_000, "1" + "." * 500_000 + "x", "a." * 300_000, "9 km " * 50_000, "Ab " * 100_000, "| --- " * 60_000, "!" * 400_000 + "z"]
    texts = [m + " " + ITEM + " " + m for m in marks] + ["- " * 100_000, ITEM.replace(" ", " - " * 2_500)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(7, ITEM), (8, "- - -"), (9, "." * 100_000)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench, shortest=1).collect()} == {(i, 7) for i in range(10) if i != 8}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, ITEM, 1, 2, 3, 4), (2, "clean", 1, 2, 3, 4)], "doc_id long, text string, _id int, _tie int, __ID int, item_id int")
    bench = spark.createDataFrame([(7, ITEM, 1)], "item_id long, text string, doc_id int")
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean", 1, 2, 3, 4)]


def test_templates_and_slots_against_plain_python(spark):
    """Numbers, names and units as templates, and slots that must agree along an alignment."""
    rng = random.Random(3)
    kind = {**{str(n): "N" for n in range(10, 30)}, **dict.fromkeys(["Maria", "Oscar", "Peter"], "P"), **dict.fromkeys(["km", "kg"], "u"), **{w: w for w in "walks then lifts over under long road".split()}}
    plain = [w for w, k in kind.items() if k == w]

    def sentence(n):
        w = [rng.choice(plain)]
        while len(w) < n:
            w.append(rng.choice(plain) if rng.random() < 0.7 else rng.choice([x for x in kind if kind[x] in "NP"]))
        return w

    def varied(w):
        swap = {x: rng.choice([y for y in kind if kind[y] == kind[x]]) for x in set(w) if kind[x] in "NP"}
        out = [swap.get(x, x) for x in w]
        if rng.random() < 0.5:
            k = rng.randrange(len(out))
            out[k] = rng.choice([y for y in kind if kind[y] == kind[out[k]]])
        return out

    items = {i: sentence(rng.randint(6, 14)) for i in range(20)}
    texts = {d: ["over", *varied(items[d % 20]), "under"] for d in range(80)}

    def judge(doc, item):
        grams = {}
        for i in range(len(item) - 4):
            own = item[i : i + 5]
            form = tuple(kind[x] for x in own)
            if sum(x not in "NP" for x in form) >= 3:
                grams.setdefault(form, []).append(i)
        lines, found, same = {}, set(), set()
        for at in range(len(doc) - 4):
            for i in range(len(item) - 4):
                if doc[at : at + 5] == item[i : i + 5]:
                    same.add(tuple(item[i : i + 5]))
                form = tuple(kind[x] for x in item[i : i + 5])
                if form in grams and form == tuple(kind[x] for x in doc[at : at + 5]):
                    lines.setdefault(at - i, []).append((form, [(x, y) for x, y in zip(item[i : i + 5], doc[at : at + 5]) if kind[x] in "NP"]))
        changed = False
        for windows in lines.values():
            values = {}
            for _, slots in windows:
                for x, y in slots:
                    values.setdefault(x, set()).add(y)
            for form, slots in windows:
                if all(len(values[x]) == 1 for x, _ in slots):
                    found.add(form)
                    changed |= any(x != y for x, y in slots)
        by_template = len(found) / len(grams) if grams else 0.0
        by_own = len(same) / len({tuple(item[i : i + 5]) for i in range(len(item) - 4)})
        return max(by_template, by_own), changed and by_own <= by_template

    want = {(d, i): v for d, t in texts.items() for i, w in items.items() if (v := judge(t, w))[0] >= 0.5}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.containment, r.reparameterised) for r in contaminated(docs, bench).collect()}
    assert got == want and len({v[1] for v in want.values()}) == 2
