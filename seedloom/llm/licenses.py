"""License scans: phrases, and an exact containment join with license templates. DataFrame functions only.

A text block is a run of words, over any lines, twice as long as a template. A block
matches the template when it holds at least a share of the template's distinct
words (containment |T and B| / |T|). Only a document that holds this share anywhere
can have such a block: these documents come from a containment join, then each run of
theirs is counted. The join's candidates come from a prefix filter: with
the template's words in the order of how rarely documents have them, a document that matches has
one of the first |T| - ceil(t |T|) + 1; it must have enough words (length
filter), and the place of its rarest shared word leaves enough words after it (positional filter).
Document frequencies of all template words come from all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Words of a block for each word of the template: notices may have words put in.
BLOCK = 2

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The notices by which texts say their license, from the licenses themselves.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: The words by which a notice is told from those of other licenses. They must stand in a block in this order
#: for those templates of the label that have them; texts of the other templates are long and hold little of each other.
TELLING = {
    "mit": ("mit license",),
    "apache-2.0": ("apache license version 2 0",),
    "gpl-3.0": ("gnu general public license version 3",),
    "gpl-2.0": ("gnu general public license version 2",),
    "gpl": ("gnu general public license",),
    "lgpl": ("gnu lesser general public license",),
    "mpl-2.0": ("mozilla public license v 2 0",),
    "cc-by-4.0": ("creative commons attribution 4 0", "cc by 4 0"),
    "cc-by-sa-4.0": ("cc by sa 4 0",),
    "cc-by-nc-4.0": ("cc by nc 4 0",),
    "unlicense": ("unencumbered software",),
}


def spaced(text: Column) -> Column:
    """Words of a text, A-Z lowered, joined and enclosed by single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP, " ")), F.lit(" "))


def template_rows(spark: SparkSession, templates=TEMPLATES, telling=None) -> DataFrame:
    """template (number), label, telling (its telling words, spaced; none unless given), length (all words), words (distinct)."""
    rows = spark.createDataFrame([(i, label, text, [f" {p} " for p in (telling or {}).get(label, ())]) for i, (label, text) in enumerate(templates)], "template int, label string, text string, phrases array<string>")
    words = F.split(F.trim(spaced(F.col("text"))), " ")
    own = F.filter("phrases", lambda p: spaced(F.col("text")).contains(p))
    return rows.select("template", "label", own.alias("telling"), F.size(words).alias("length"), F.array_distinct(words).alias("words"))


def ordered_templates(words: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Templates with their words in the order of document frequency, and how many of them a block must hold.

    words has one array column `words`, a row per document.
    """
    wanted = [w for r in templates.select("words").collect() for w in r.words]  # the templates' own few hundred words
    seen = words.select(F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in sorted(set(wanted))]))).alias("word")).groupBy("word").count()
    each = templates.select("template", "label", "telling", "length", F.explode("words").alias("word")).join(F.broadcast(seen), "word", "left")
    order = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word"))), lambda x: x["word"])
    return each.groupBy("template", "label", "telling", "length").agg(order.alias("words")).withColumn("need", F.ceil(F.size("words") * containment).cast("int"))


def matches(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """The blocks' other columns with label, telling, length, need and words (whole) of each template that a block holds.

    blocks has an array column `words` of distinct words.
    """
    rest = [c for c in blocks.columns if c != "words"]
    prefix = templates.select("template", "label", "telling", "length", "need", F.size("words").alias("size"), F.col("words").alias("whole"), F.posexplode(F.slice("words", F.lit(1), F.size("words") - F.col("need") + 1)).alias("place", "token"))
    prefix = F.broadcast(prefix)  # a row for each prefix word of the fixed templates
    tokens = sorted({w for r in templates.select(F.slice("words", F.lit(1), F.size("words") - F.col("need") + 1).alias("p")).collect() for w in r.p})
    some = blocks.withColumn("_tokens", F.array_intersect("words", F.array(*[F.lit(t) for t in tokens])))
    some = some.filter(F.size("_tokens") > 0).withColumn("token", F.explode("_tokens"))
    pairs = some.join(prefix, "token").filter((F.size("words") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need")))
    # of several shared prefix words only the first, rarest one keeps the pair
    first = F.array_position(F.transform("whole", lambda w: F.array_contains("words", w)), True) - 1
    pairs = pairs.filter(first == F.col("place"))
    shared = F.size(F.array_intersect("words", "whole"))
    return pairs.filter(shared >= F.col("need")).select(*rest, "label", "telling", "length", "need", "whole")


def held(pairs: DataFrame) -> DataFrame:
    """The pairs of which a block of the text holds the template and its telling words, with the best block's containment.

    pairs has spaced texts and the columns of matches().
    """
    told = lambda text: (F.size("telling") == 0) | F.exists("telling", lambda p: text.contains(p))
    pairs = pairs.filter(told(F.col("spaced")))

    def best(words: Column) -> Column:
        # word by word: slice() takes time for the whole array
        block = lambda i: F.transform(F.sequence(i, F.least(i + F.col("length") * BLOCK, F.size(words)) - 1), lambda j: F.get(words, j))
        # a block that starts at no word of the template holds no more than the one from the next such word on
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains("whole", w), i)), lambda i: i.isNotNull())
        held = lambda b: F.when(told(F.concat(F.lit(" "), F.array_join(b, " "), F.lit(" "))), F.size(F.array_intersect(b, "whole")))
        return F.array_max(F.transform(starts, lambda i: F.get(F.transform(F.array(block(i)), held), 0)))

    # bound as a lambda's variable, the words are split once
    pairs = pairs.withColumn("shared", F.get(F.transform(F.array(F.split(F.trim("spaced"), " ")), best), 0))
    return pairs.filter(F.col("shared") >= F.col("need")).withColumn("containment", F.col("shared") / F.size("whole")).drop("shared")


def _places(text: Column, phrase: str) -> Column:
    """n, first, last: how often the phrase starts in a spaced text, and the first and last word, from 0, at which it does.

    The words before the first place and after the last one are counted, so that the time grows with the text alone.
    """
    gaps = F.split(text, f"(?<= ){phrase}(?= )", -1)
    words = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - 1
    n = F.size(gaps) - 1
    last = words(text) - words(F.element_at(gaps, -1)) - (phrase.count(" ") + 1)
    return F.when(n > 0, F.struct(n.alias("n"), words(gaps[0]).alias("first"), last.alias("last")))


def scan(docs: DataFrame, containment: float = CONTAINMENT, templates=TEMPLATES, telling=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    score is 1 where a phrase stands, else the best containment of a template
    that a block of the text holds, else 0. With telling (TELLING), the block must also hold the
    template's telling words; without, notices of like wording get each other's labels. Null text has no words. Rows that share an id are
    told apart by their texts; equal rows have equal results; null ids are kept; an empty table gives no rows;
    other columns are not read. The time of a text grows with its words, however many notices it holds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = spaced(F.col("text"))
    fixed = template_rows(spark, templates, telling)
    ordered = ordered_templates(rows.select(F.split(F.trim(low), " ").alias("words")), fixed, containment)
    ordered = written(ordered, "license-templates")

    # every template has a word of these in each document that holds it
    tokens = [r.token for r in ordered.select(F.explode(F.slice("words", F.lit(1), F.size("words") - F.col("need") + 1)).alias("token")).distinct().collect()]
    vocabulary = sorted({w for r in ordered.select("words").collect() for w in r.words})
    keyed = rows.select("doc_id", F.xxhash64("text").alias("tie"), low.alias("spaced"))
    maybe = keyed.filter(F.col("spaced").rlike(" (?:" + "|".join(sorted(tokens)) + ") "))
    maybe = maybe.withColumn("words", F.array_intersect(F.split(F.trim("spaced"), " "), F.array(*[F.lit(w) for w in vocabulary])))
    found = held(matches(maybe, ordered)).groupBy("doc_id", "tie").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))

    places = [(label, _places(F.col("spaced"), phrase)) for phrase, label in PHRASES.items()]
    any_phrase = F.col("spaced").rlike(" (?:" + "|".join(PHRASES) + ") ")
    n_words = F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit("")))
    out = keyed.select("doc_id", "tie", F.when(F.trim("spaced") == "", F.lit(0)).otherwise(n_words - 1).cast("long").alias("n_words"), F.when(any_phrase, F.struct(*(p.alias(label) for label, p in places))).alias("p"))
    places = F.filter(F.array(*(F.when(F.col("p").getField(label).isNotNull(), F.struct(F.lit(label).alias("label"), F.col("p").getField(label).alias("p"))) for label, _ in places)), lambda x: x.isNotNull())
    base = out.select("doc_id", "tie", "n_words", F.when(F.col("p").isNotNull(), places).otherwise(F.array().cast("array<struct<label:string,p:struct<n:int,first:int,last:int>>>")).alias("at"))
    base = base.select("doc_id", "tie", "n_words", "at", F.col("at.label").alias("base"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tie") == F.col("b.tie"))
    rows = base.alias("a").join(found.alias("b"), same, "left").select("a.*", "b.more", "b.best")
    labels = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate(F.col("at.p.n"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"),
        F.array_min(F.col("at.p.first")).cast("long").alias("first_word"),
        F.array_max(F.col("at.p.last")).cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), telling=TELLING)
