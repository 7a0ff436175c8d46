"""License scans by diagonal voting.

Every pair of neighbouring words of every text (a rolling k-gram, k = 2) is hashed and joined with the positions of
the same pair in license templates; the words themselves are compared too, so a collision of hashes finds nothing.
A hit votes for the diagonal *place in the text minus place in the template*.  Diagonals of one text and template
that lie within ``SLACK`` words of each other are merged (words may have been put in or left out), and each merged span
is verified: the longest chain of its hits that runs forward in the text and in the template, within one stretch of
the text, must reach ``SHARE`` of the template's pairs.  The stretch is as long as the template and what may have been
put in where the share allows a pair to be missed, so neither repetition nor disorder nor a long row of diagonals
makes a whole of a part.  Phrases are templates without slack: all their pairs must vote for the same diagonal.
The score is 1 where a phrase stands, else the largest verified part of a template.

The template table has one row for each word pair of the templates (a few hundred, a parameter and never the data),
so it is broadcast.  Every pair of every text meets it in one pass over the texts, which never move; what is shuffled,
once and by text, is hits: a few numbers each.

Defined results: a null or empty text has no words and no labels, and score 0; repeated rows are scanned one by one;
a text of any length is one row of hits a template; further columns are ignored; without templates only phrases are
found.

Native: DataFrame and SQL operations only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES: dict[str, Sequence[str]] = {
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "lgpl": ["gnu lesser general public license"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "proprietary": ["all rights reserved"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
}
SLACK, SHARE = 3, 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """(hash, first, second, template, label, phrase, place, pairs, same): a row for each pair of neighbouring words.

    ``pairs`` is how many the template has, ``same`` how often its most frequent one stands in it.
    """
    rows = []
    for number, (label, text, phrase) in enumerate(
        [*((l, p, True) for p, l in phrases.items()), *((l, t, False) for l, ts in templates.items() for t in ts)]
    ):
        words = re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))
        pairs = list(zip(words, words[1:]))
        same = max((pairs.count(p) for p in pairs), default=0)
        rows += [f"('{a}', '{b}', {number}, '{label}', {str(phrase).lower()}, {i}, {len(pairs)}, {same})" for i, (a, b) in enumerate(pairs)]
    values = ", ".join(rows) or "('', '', -1, '', false, 0, 1, 1)"
    return spark.sql(
        f"SELECT xxhash64(first, second) AS hash, * FROM VALUES {values} AS t(first, second, template, label, phrase, place, pairs, same)"
    )


def hits(docs: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, at, template, label, phrase, place, pairs, same) of each hit, and one row at least for each text."""
    listed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_list(F.col(text)).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    listed = listed.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), pairs.alias("pairs_"))
    grams = listed.select("row", "doc_id", "n_words", F.posexplode_outer("pairs_").alias("at", "g"))
    grams = grams.select("row", "doc_id", "n_words", "at", F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    t = F.broadcast(table)
    # One number is looked up for each pair; the words are compared where it is found.
    met = grams.join(t, F.xxhash64("a", "b") == t.hash, "left")
    equal = F.coalesce((F.col("a") == F.col("first")) & (F.col("b") == F.col("second")), F.lit(False))
    kept = met.filter(equal | (F.coalesce("at", F.lit(0)) == 0))
    return kept.select(
        "row",
        "doc_id",
        "n_words",
        "at",
        *[F.when(equal, F.col(c)).alias(c) for c in ("template", "label", "phrase", "place", "pairs", "same")],
    )


def _chain(window: Column) -> Column:
    """The length of the longest chain of hits whose places rise; of hits at one word at most one is in it."""

    def step(tails: Column, hit: Column) -> Column:
        place = -hit["back"]
        before = F.size(F.filter(tails, lambda t: t < place))
        return F.concat(F.slice(tails, F.lit(1), before), F.array(place), F.slice(tails, before + 2, F.size(tails)))

    return F.size(F.aggregate(window, F.expr("cast(array() as array<int>)"), step))


def verified(found: Column, width: Column, most: Column) -> Column:
    """The longest chain of a span's hits (at, back: minus the place; sorted) within ``width`` words.

    A stretch starts at a hit and holds at most ``most`` hits.
    """
    extent = F.element_at(found, -1)["at"] - F.element_at(found, 1)["at"]

    def stretch(i: Column) -> Column:
        start = F.element_at(found, i)["at"]
        return _chain(F.filter(F.slice(found, i, most), lambda h: h["at"] - start < width))

    whole = F.when(extent < width, _chain(found)).otherwise(F.array_max(F.transform(F.sequence(F.lit(1), F.size(found)), stretch)))
    return F.when(F.size(found) <= 1, F.size(found)).otherwise(whole)


def scan(
    docs: DataFrame,
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    slack: int = SLACK,
    share: float = SHARE,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    of = ["row", "doc_id", "n_words", "template", "label", "phrase", "pairs", "same"]
    found = hits(docs, template_table(docs.sparkSession, phrases, templates), text).repartition("row")  # all that follows keeps to it
    hit = F.when(F.col("template").isNotNull(), F.struct("at", (-F.col("place")).alias("back")))
    votes = found.groupBy(*of, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_list(hit).alias("hits"))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(~F.col("phrase") & (F.col("diagonal") - F.lag("diagonal").over(along) <= slack), 0).otherwise(1)
    spans = votes.withColumn("span", F.sum(apart).over(along.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy(*of, "span").agg(F.min("diagonal").alias("start"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    needed = F.ceil(F.lit(share) * F.col("pairs")).cast("int")
    width = F.col("pairs") + slack * (F.col("pairs") - needed)
    chain = F.when(F.col("phrase"), F.size("hits")).otherwise(verified(F.col("hits"), width, width * F.col("same")))
    spans = spans.withColumn("chain", F.when(F.col("template").isNotNull(), chain)).withColumn(
        "needed",
        F.when(F.col("phrase"), F.col("pairs")).otherwise(needed),
    )
    base, more = F.col("phrase") & (F.col("chain") >= F.col("needed")), ~F.col("phrase") & (F.col("chain") >= F.col("needed"))
    places = F.when(base, F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(places).cast("long").alias("n_base"),
        F.min(places).cast("long").alias("first_word"),
        F.max(places).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(base | more, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(base, 1.0).when(~F.col("phrase"), F.col("chain") / F.col("pairs"))), F.lit(0.0)).alias("score"),
    ).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
