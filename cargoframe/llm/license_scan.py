"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of the documents are joined with the k-gram positions of the
templates. A hit votes for the diagonal (document position minus template position) of its
template; votes are the distinct template positions hit. Diagonals no further apart than
``NEAR`` words are merged into one span, which bridges missing and added words. A span of a notice
needs votes for a quarter of its grams, counted over all its diagonals. A span is verified on the words themselves: a phrase must stand there word for word, a notice must have
``COVERAGE`` of its words inside the span.

Null and empty texts have no word and no label. Repeated rows get one result row each. An empty
table gives no row. Templates are a parameter of fixed size; only they are broadcast.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

SHORT, LONG = 2, 4
NEAR, COVERAGE = 4, 0.7

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Openings of public licence notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license": "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "released under the mit license": "mit",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _GAP), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """(position, hash) of every k consecutive words."""
    shifted = F.arrays_zip(*[F.slice(words, j + 1, F.size(words) - (k - 1)).alias(f"w{j}") for j in range(k)])
    return F.transform(shifted, lambda z, i: F.struct(
        i.alias("at"), F.xxhash64(*[z[f"w{j}"] for j in range(k)]).alias("gram")))


def _once(value: Column) -> Column:
    """A generator of one row: what is built on the value later does not compute it again."""
    return F.explode(F.array(value))


def _all_grams(words: Column) -> Column:
    """Hashes of both widths; a text with fewer words than a width has none of it."""
    empty = F.array().cast("array<struct<at:int,gram:bigint>>")
    return F.concat(*[F.when(F.size(words) >= k, _grams(words, k)).otherwise(empty) for k in (SHORT, LONG)])


def _templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """Template positions: one row per gram. As many rows as the templates have words."""
    rows = [(i, text.split(), label, i < len(phrases)) for i, (text, label) in
            enumerate([*phrases.items(), *notices.items()])]
    literal = F.array(*[
        F.struct(F.lit(i).alias("template"), F.array(*[F.lit(w) for w in words]).alias("words"),
                 F.lit(label).alias("label"), F.lit(base).alias("base")) for i, words, label, base in rows])
    return spark.range(1).select(F.inline(literal))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of the phrases), first_word and last_word
    (their least and greatest start), base_labels, labels (with those of the notices), score (largest
    share of a template found) and spans (template, label, first, end, share)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    templates = _templates(spark, phrases, notices)
    width = F.when(F.size("words") < 9, F.lit(SHORT)).otherwise(F.lit(LONG))
    grams = templates.withColumn("k", width).select(
        "template", F.size("words").alias("n"), "k", "base",
        F.inline(F.when(F.col("k") == SHORT, _grams(F.col("words"), SHORT)).otherwise(_grams(F.col("words"), LONG)))
    ).select("template", "n", "k", "base", F.col("at").alias("place"), "gram")
    # key of a row: equal rows share it, and share their result
    keyed = source.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _once(_words(F.col("text"))).alias("words"))
    hits = (
        keyed.select("row", F.explode(_all_grams(F.col("words"))).alias("g"))
        .select("row", "g.at", "g.gram").join(F.broadcast(grams), "gram")
        .select("row", "template", "n", "k", "base", (F.col("at") - F.col("place")).alias("diagonal"), "place"))
    # at most one place per word of a template
    votes = hits.groupBy("row", "template", "n", "k", "base", "diagonal").agg(F.collect_set("place").alias("places"))
    # phrases need all their hits on one diagonal, notices a quarter over the diagonals of a span
    grams_of = F.col("n") - F.col("k") + 1
    votes = votes.filter(~F.col("base") | (F.size("places") == grams_of))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.when(~F.col("base") & (step <= NEAR), 0).otherwise(1)
    spans = (
        votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
        .groupBy("row", "template", "span", "base", "n", "k").agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("hit"),
            F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("places") + F.col("k")).alias("end"))
        .filter(F.col("base") | (4 * F.col("hit") >= grams_of))
        .groupBy("row").agg(F.collect_list(F.struct("template", "first", "end")).alias("spans")))
    known = F.broadcast(templates.groupBy().agg(F.collect_list(
        F.struct("template", "words", "label", "base")).alias("known")))
    # the texts move, not the longer word lists
    joined = source.withColumn("row", F.xxhash64("doc_id", "text")).join(spans, "row", "left").select(
        "doc_id", "spans", _once(_words(F.col("text"))).alias("words")).crossJoin(known)

    def verify(span: Column) -> Column:
        """The span with its template's words found there, in order of place."""
        template = F.element_at(F.filter(F.col("known"), lambda t: t["template"] == span["template"]), 1)
        inside = F.slice(F.col("words"), span["first"] + 1, span["end"] - span["first"])
        share = F.when(template["base"], (inside == template["words"]).cast("double")).otherwise(
            F.size(F.filter(template["words"], lambda w: F.array_contains(inside, w))) / F.size(template["words"]))
        return F.struct(span["template"].alias("template"), template["label"].alias("label"),
                        template["base"].alias("base"), span["first"].alias("first"), span["end"].alias("end"),
                        share.alias("share"))

    none = F.array().cast("array<struct<template:int,first:int,end:int>>")
    found = joined.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform(F.coalesce("spans", none), verify), lambda s: s["share"] >= COVERAGE).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])

    def names(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"), "spans")
