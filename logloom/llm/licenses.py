"""License scan by diagonal voting, on Spark functions only.

The words of a text are cut into rolling k-grams, whose hashes are joined with
the positions of the same k-grams in the license templates. A hit votes for
its diagonal, the document place minus the template place; votes are summed by
(document, template, diagonal), neighbouring diagonals (a few words inserted or
left out) are merged, and the span is verified: a hit's k-gram equals the
template's word by word, a template place counts once, at its first word in the
span, and only if it lies behind all earlier places; enough of the template must
be covered, and covered densely. Of spans that overlap by more than half, the
one that covers most words stays, so a notice is not labelled as the shorter
notice it contains.

The templates are a fixed list, so their k-gram table (a few hundred rows) is
broadcast; documents are not shuffled, only their hits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.common import text_of, write_once

K = 3
MAX_SHIFT = 4
MIN_COVER = 0.6
MIN_DENSITY = 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Usual license notices, one label each.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is "
                   "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited "
            "to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("reserved", "all rights reserved"),
]


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP, -1), lambda w: w != "")


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, size, place, gram, hash): every k-gram of every template."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = text.replace(".", " ").split()
        rows += [(number, label, len(words) - k + 1, i, " ".join(words[i:i + k])) for i in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, size int, place int, words string")
    return grams.withColumn("hash", F.xxhash64("words"))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))
    same = lambda i: F.slice(words, i + 1, len(parts)) == F.array(*[F.lit(p) for p in parts])
    some = F.size(words) >= len(parts)
    for p in parts:  # cheap test before the places are looked through
        some = some & F.array_contains(words, p)
    return F.when(some, F.filter(at, same)).otherwise(F.array().cast("array<int>"))


def license_hits(docs: DataFrame, templates=TEMPLATES, k: int = K, max_shift: int = MAX_SHIFT,
                 min_cover: float = MIN_COVER) -> tuple[DataFrame, DataFrame]:
    """Two frames: one row per document (rid, doc_id, n_words, bases: places per
    base phrase) and the verified spans (rid, label, cover, first, last; words
    from 0, last exclusive)."""
    spark = docs.sparkSession
    worded = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                         words_of(text_of()).alias("words"))
    # One pass: element 0 of a document holds its own facts, the others its
    # k-grams. Rows are narrow: no row carries the words of the whole document.
    bases = F.array(*[_places(F.col("words"), p) for p, _ in PHRASES])
    facts = F.named_struct(F.lit("n_words"), F.size("words").cast("long"), F.lit("bases"), bases,
                           F.lit("gram"), F.lit(None).cast("string"))
    places = F.slice("words", 1, F.greatest(F.size("words") - (k - 1), F.lit(0)))
    grams = F.transform(places, lambda w, i: F.named_struct(
        F.lit("n_words"), F.lit(None).cast("long"), F.lit("bases"), F.lit(None).cast("array<array<int>>"),
        F.lit("gram"), F.concat_ws(" ", F.slice("words", i + 1, k))))
    rows = (worded.select("rid", "doc_id", F.posexplode(F.concat(F.array(facts), grams)).alias("at", "x"))
            .select("rid", "doc_id", "at", "x.*").withColumn("key", F.xxhash64("gram")))
    table = F.broadcast(template_grams(spark, templates, k))
    joined = rows.join(table, (rows["key"] == table["hash"]) & (rows["gram"] == table["words"]), "left")
    kept = write_once(joined.where("at = 0 or template is not null").select(
        "rid", "doc_id", "n_words", "bases", (F.col("at") - 1).cast("long").alias("word"), "template", "label", "size", "place"),
        "licensehits")
    documents = kept.where("word = -1").select("rid", "doc_id", "n_words", "bases")
    hits = kept.where("template is not null").withColumn("diagonal", F.col("word") - F.col("place"))
    # Votes by diagonal; hits a template length apart on one diagonal are other copies.
    run = Window.partitionBy("rid", "template", "diagonal").orderBy("word")
    ranged = (hits.withColumn("new", (F.col("word") - F.lag("word", 1, -1 << 40).over(run) > F.col("size")).cast("int"))
              .withColumn("part", F.sum("new").over(run)))
    votes = ranged.groupBy("rid", "template", "label", "size", "diagonal", "part").agg(
        F.count("*").alias("votes"), F.min("word").alias("first"), F.max("word").alias("last"))
    side = Window.partitionBy("rid", "template").orderBy("diagonal", "first")
    grouped = (votes.withColumn("far", (
        (F.col("diagonal") - F.lag("diagonal", 1, -1 << 40).over(side) > max_shift)
        | (F.abs(F.col("first") - F.lag("last", 1, -1 << 40).over(side)) > F.col("size"))).cast("int"))
        .withColumn("span", F.sum("far").over(side)))
    # Verification: each template place once, at its first word in the span, in
    # the template's order.
    placed = ranged.join(grouped.select("rid", "template", "diagonal", "part", "span"), ["rid", "template", "diagonal", "part"])
    once = placed.groupBy("rid", "template", "label", "size", "span", "place").agg(F.min("word").alias("word"))
    order = Window.partitionBy("rid", "template", "span").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    in_order = once.withColumn("behind", F.coalesce(F.col("word") > F.max("word").over(order), F.lit(True)))
    merged = in_order.where("behind").groupBy("rid", "template", "label", "size", "span").agg(
        F.count("*").alias("covered"), F.min("word").alias("first"), (F.max("word") + k).alias("last"))
    dense = F.col("covered") + (k - 1) >= MIN_DENSITY * (F.col("last") - F.col("first"))
    spans = merged.withColumn("cover", F.col("covered") / F.col("size")).where((F.col("cover") >= min_cover) & dense)
    return documents, _standing(spans)


def _standing(spans: DataFrame) -> DataFrame:
    """The spans that no better span of another label overlaps by more than half
    of the shorter: better covers more places, or as many and a larger share,
    or its label is the smaller. A document has few verified spans per word."""
    facts = F.struct("first", "last", "covered", "cover", "label")
    per_doc = spans.groupBy("rid").agg(F.array_sort(F.collect_list(facts)).alias("all"))

    def beaten(s):
        def by(o):
            shared = F.least(s["last"], o["last"]) - F.greatest(s["first"], o["first"])
            shorter = F.least(s["last"] - s["first"], o["last"] - o["first"])
            better = ((o["covered"] > s["covered"]) | (o["covered"] == s["covered"]) & (
                (o["cover"] > s["cover"]) | (o["cover"] == s["cover"]) & (o["label"] < s["label"])))
            return (o["label"] != s["label"]) & (2 * shared > shorter) & better

        return by

    kept = per_doc.select("rid", F.explode(F.filter("all", lambda s: ~F.exists("all", beaten(s)))).alias("s"))
    return kept.select("rid", "s.label", "s.cover", "s.first", "s.last")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best cover of a template, 1 for a base
    phrase, 0 for neither). The notices found are those of ``TEMPLATES``, a few
    usual sentences of each license, not the full license texts.

    A null text is empty. Rows that repeat a doc_id are documents of their own.
    An empty table gives an empty result; further columns are ignored."""
    documents, spans = license_hits(docs)
    by_doc = spans.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    names = F.array(*[F.lit(n) for _, n in PHRASES])
    base = F.array_sort(F.filter(F.transform("bases", lambda b, i: F.when(F.size(b) > 0, F.get(names, i))), lambda x: x.isNotNull()))
    places = F.flatten("bases")
    return documents.join(by_doc, "rid", "left").select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"))
