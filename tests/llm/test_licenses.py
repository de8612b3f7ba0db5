import random
import re
import textwrap
import time

from seedloom.llm.licenses import CONTAINMENT, PHRASES, TELLING, TEMPLATES, op10_licenses, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
words = lambda t: WORD.findall(low(t))


def brute(text):
    w = words(text or "")
    at, names = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        names |= {label} if hits else set()
    labels, best = set(names), 0.0
    for block in (text or "").split("\n"):
        b = set(words(block))
        for label, t in TEMPLATES:
            t = set(words(t))
            if len(t & b) >= CONTAINMENT * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(t & b) / len(t))
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(labels)), 1.0 if names else best


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = [w for _, t in TEMPLATES for w in t.split()]
    texts = [None, "", " \n ", "cc by cc by, CC BY-NC 4.0 é", "The GNU General\nPublic License; mit license MIT License", "ccby cc-by xcc by", "plain words", "ünïcode mit license"]
    for _ in range(60):
        t = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(["zz", rng.choice(pool)])
        texts.append("some line\n" + " ".join(t) + rng.choice(["", "\n\nmore", " tail"]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[4]), (3, texts[4])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, words int").repartition(3)
    got = scan(df).collect()
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(str((r.doc_id, *(r[f] for f in fields))) for r in got) == sorted(str((k, *brute(t))) for k, t in rows)
    assert scan(df.limit(0)).count() == 0


def test_notices_wrapped_over_lines(spark):
    texts = [f"first line\n\n# {mark.join(textwrap.wrap(t, 30))}\n\nlast line" for _, t in TEMPLATES for mark in ("\n", "\n# ", "\n\n * ")]
    wanted = [label for label, _ in TEMPLATES for _ in range(3)]
    scattered = TEMPLATES[2][1].replace(" ", " filler words between them ")
    df = spark.createDataFrame([*enumerate(texts), (-1, scattered)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in enumerate(wanted))
    assert got[-1].labels == "" and got[-1].score == 0.0


def test_query_tells_licenses_apart(spark, tmp_path):
    of = {t: ",".join(sorted({label} | {b for p, b in PHRASES.items() if p in " ".join(words(t))})) for label, t in TEMPLATES}
    of |= {
        "licensed under the GNU General Public License, version 3": "gpl",
        "He was licensed under the law, and the license was his": "",
        "Licensed under CC BY-ND 4.0.": "cc-by",
        "Licensed under a CC BY-NC 4.0 license": "cc-by,cc-by-nc-4.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
        "This is free software released into the public domain": "",
        "Licensed under the MIT\nLicense. Licensed under the\nApache License, Version 2.0.": "apache,apache-2.0,mit",
    }
    texts = list(of)
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {texts[r.doc_id]: r.labels for r in op10_licenses(spark, str(tmp_path)).collect()} == of


def test_long_texts_with_many_notices(spark):
    texts = ["mit license " * 20_000, "cc by " * 100_000 + "4.0", "Licensed under the MIT License. " * 3_000, "- " * 200_000, "the " * 100_000, "x" * 500_000, ("word " * 50_000) + "Apache License"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    start = time.perf_counter()
    got = {r.doc_id: r for r in scan(df, telling=TELLING).collect()}
    assert time.perf_counter() - start < 60
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].n_words) for i in range(7)] == [(20_000, 0, 39_998, 40_000), (100_000, 0, 199_998, 200_002), (3_000, 3, 14_998, 15_000), (0, None, None, 0), (0, None, None, 100_000), (0, None, None, 1), (1, 50_000, 50_000, 50_002)]
    assert [got[i].base_labels for i in range(7)] == ["mit", "cc-by", "mit", "", "", "", "apache"]
