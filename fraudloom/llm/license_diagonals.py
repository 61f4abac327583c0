"""License scan by diagonal voting: word n-grams of texts meet positions of license templates.

A gram at word p of a text and word t of a template votes for the diagonal p - t. A passage that
follows a template gathers its votes on one diagonal, or on neighbouring ones where words were added
or left out. Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Phrases whose places are counted, and the label of each.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Opening words of public license notices, and the label of each.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of "
     "the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
     "copy of the MPL was not distributed with this file, You can obtain one at", "mpl"),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International "
     "License", "cc-by-nc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]

#: Words of a gram: of short templates, and of those with at least LONG words.
SHORT_GRAM, GRAM, LONG = 2, 4, 8
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words after A-Z are lowered: what stands between ASCII characters other than letters and digits."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _GAP), "")


def _pairs(values: Column, step: int) -> Column:
    """Joins each value with the one `step` places on."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(step + 1), n),
                      lambda a, b: F.xxhash64(a, b))


def _with_grams(rows: DataFrame) -> DataFrame:
    """Adds hashes of all grams of two words (`g2`) and of four (`g4`)."""
    hashed = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    paired = hashed.withColumn("g2", _pairs(F.col("h"), 1)).drop("h")
    return paired.withColumn("g4", _pairs(F.col("g2"), 2))


def template_positions(spark: SparkSession, phrases: list, notices: list) -> DataFrame:
    """(gram, template, at, size, said, label, phrase, n_grams, length): every gram of every
    template with its words; as many rows as the templates have words."""
    listed = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *notices])]
    rows = spark.createDataFrame(listed, "template int, text string, label string, phrase boolean")
    known = _with_grams(rows.withColumn("words", words_of(F.col("text")))).withColumn(
        "length", F.size("words"))
    wide = (F.col("length") >= LONG) & ~F.col("phrase")
    return known.withColumn("size", F.when(wide, GRAM).otherwise(SHORT_GRAM)).select(
        "template", "label", "phrase", "length", "size", "words",
        (F.col("length") - F.col("size") + 1).alias("n_grams"),
        F.posexplode(F.when(wide, F.col("g4")).otherwise(F.col("g2"))).alias("at", "gram")).select(
        "gram", "template", "at", "size", "label", "phrase", "n_grams", "length",
        F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("said"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: list | None = None, notices: list | None = None,
                  similarity: float = 0.6, slack: int = 3) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): one row per
    row of `docs`.

    `phrases` must stand word for word, on one diagonal; n_base counts their places, first_word and
    last_word are the smallest and largest start. `notices` count where the merged diagonals cover
    at least `similarity` of their words; diagonals at most `slack` apart are merged, so that many
    words may be added or left out between parts. `spans` lists (template, label, from_word,
    to_word, coverage) of all of them; the score is the best coverage, 1 for a phrase and 0 for
    nothing. Phrases need two words, notices eight.

    NULL and empty texts have no words and no label; repeated rows each get their row, NULL ids
    too; an empty table gives an empty result; other columns are ignored. Texts are read whole; of
    each row, only grams that meet a template and one row of counts are shuffled, and templates
    are the only side that is broadcast.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    templates = template_positions(spark, phrases, NOTICES if notices is None else notices)
    keyed = _with_grams(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"),
        F.octet_length(text_col).alias("bytes"), words_of(F.col(text_col)).alias("words")))
    # The first entry belongs to no gram: it keeps the row, with its number of words. The outer form
    # spares a filter on the size of the array, for which Spark would hash all words again.
    grams = F.concat(F.array(F.lit(None).cast("long")), "g2", "g4")
    places = keyed.select("id", "key", "bytes", "words", F.size("words").alias("n_words"), F.posexplode_outer(
        grams).alias("entry", "gram"))
    met = places.join(F.broadcast(templates), "gram", "left").filter(
        F.col("template").isNotNull() | (F.col("entry") == 0))
    pairs = F.greatest(F.col("n_words") - 1, F.lit(0))
    wide = F.col("entry") > pairs
    start = F.col("entry") - 1 - F.when(wide, pairs).otherwise(0)
    size = F.when(wide, GRAM).otherwise(SHORT_GRAM)
    said = F.array_join(F.slice("words", start + 1, size), " ")
    votes = met.filter((F.col("entry") == 0) | (size == F.col("size")) & (said == F.col("said"))).select(
        "id", "key", "bytes", F.col("n_words").cast("long").alias("n_words"), "template", "label",
        "phrase", "size", "n_grams", "length", "at", (start - F.col("at")).alias("diagonal"))
    own = ["id", "key", "bytes", "n_words"]
    about = ["template", "label", "phrase", "size", "n_grams", "length"]
    diagonals = votes.groupBy(*own, *about, F.when(F.col("template").isNotNull(), F.col("diagonal")).alias(
        "diagonal")).agg(F.collect_set("at").alias("at"), F.count(F.lit(1)).alias("copies"))
    verified = _merged(diagonals, own, about, slack, similarity)
    return verified.groupBy(*own).agg(
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("from_word"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("from_word"))).alias("last_word"),
        _listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        _listed(F.col("label")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("template").isNotNull(), F.struct(
            "from_word", "to_word", "template", "label", "coverage")))).alias("spans"),
    ).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        "labels", "score", "spans")


def _listed(label: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(label)), ",")


def _merged(diagonals: DataFrame, own: list[str], about: list[str], slack: int,
            similarity: float) -> DataFrame:
    """Phrases that are whole on their diagonal, neighbouring diagonals of notices merged and
    verified, and the row of counts that each text has."""
    # Phrases are told apart by their diagonal; neighbouring ones are places of their own.
    group = Window.partitionBy(*own, *about).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(group)
    runs = diagonals.withColumn("new", (F.col("phrase") | F.coalesce(gap > slack, F.lit(True))).cast(
        "int")).withColumn("run", F.sum("new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*own, *about, "run").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.min(F.col("diagonal") + F.array_min("at")).cast("long").alias("from_word"),
        F.max(F.col("diagonal") + F.array_max("at") + F.col("size")).cast("long").alias("to_word"),
        F.max("copies").alias("copies"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "at", lambda a: F.sequence(a, a + F.col("size") - 1)))))
    scored = merged.withColumn("coverage", F.when(
        F.col("template").isNotNull(), covered / F.col("length")))
    return scored.filter(
        F.col("template").isNull() | F.when(F.col("phrase"), F.size("at") == F.col("n_grams"))
        .otherwise(F.col("coverage") >= similarity))
