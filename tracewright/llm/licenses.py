"""License scans by diagonal voting, in Spark's own expressions.

Templates (license notices, and phrases that name a license) are cut into rolling k-grams of words. All rolling k-grams
of the documents whose words are all template words, which are the only ones that can match, are joined to the
templates' positions on hash and words. A match votes for its diagonal, document position minus template position; diagonals of one template
that lie within `gap` of each other (words were put in or left out between them) are merged into one span, and a span
counts if enough of the template's words stand in it. Phrases are templates of one k-gram: each diagonal is one place.

The templates are constants of this module or an argument of the driver's, so their broadcast is bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import common

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# The public notices of common licenses, with their labels.
NOTICES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
    ),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ),
    (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
    ),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
)


def template_grams(spark, notices, phrases, k: int) -> DataFrame:
    """template, label, is_phrase, n_words, k, t_at, h, gram of every template position."""
    rows = []
    for t, (label, text, phrase) in enumerate([(b, a, True) for a, b in phrases] + [(a, b, False) for a, b in notices]):
        words = text.split()
        n = len(words) if phrase else min(k, len(words))
        rows += [(t, label, phrase, len(words), n, i, " ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    found = spark.createDataFrame(rows, "template int, label string, is_phrase boolean, n_words int, k int, t_at int, gram string")
    return found.withColumn("h", F.xxhash64("k", "gram"))


def candidate_grams(words: Column, notices, phrases, k: int) -> Column:
    """Array of (at, k, gram): k-grams of template words, and at the phrases' first words those of the phrases' lengths."""
    vocabulary = sorted({w for _, text in notices for w in text.split()})
    sizes = sorted({min(k, len(text.split())) for _, text in notices})
    firsts = {n: sorted({p.split()[0] for p, _ in phrases if len(p.split()) == n}) for n in sorted({len(p.split()) for p, _ in phrases})}
    lasts = {n: sorted({p.split()[-1] for p, _ in phrases if len(p.split()) == n}) for n in firsts}

    def grams(n: int, test) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - n), test)
        made = F.transform(
            at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("k"), F.array_join(F.slice(words, i + 1, n), " ").alias("gram"))
        )
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<struct<at:int,k:int,gram:string>>"))

    def all_known(n: int):
        def test(i: Column) -> Column:
            out = F.get(words, i).isin(vocabulary)
            for j in range(1, n):
                out = out & F.get(words, i + j).isin(vocabulary)
            return out

        return test

    def at_phrase(n: int):
        return lambda i: F.get(words, i).isin(firsts[n]) & F.get(words, i + n - 1).isin(lasts[n])

    parts = [grams(n, all_known(n)) for n in sizes]
    parts += [grams(n, at_phrase(n)) for n in firsts]
    return F.concat(*parts)


def scan_licenses(docs: DataFrame, notices=NOTICES, phrases=PHRASES, k: int = 4, gap: int = 6, least_share: float = 0.5) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each row of docs.

    Null texts have no words. Repeated rows give equal rows; equal ids are told apart. spans has (label, first, last,
    share) of each verified notice. score: the largest share of a template found; a phrase alone counts 0.5. Of equal
    notices each has its own span. Texts are whole however long they are; an empty table gives an empty result. Other
    columns of docs are ignored.
    """
    templates = F.broadcast(template_grams(docs.sparkSession, notices, phrases, k))
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = common.let(
        common.words(F.col("text")),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), candidate_grams(ws, notices, phrases, k).alias("grams"))
    )
    rows = cut.select("row", "doc_id", made.alias("x")).select("row", "doc_id", "x.n_words", F.explode_outer("x.grams").alias("g"))
    rows = rows.select("row", "doc_id", "n_words", "g.*").withColumn("h", F.when(F.col("gram").isNotNull(), F.xxhash64("k", "gram")))
    votes = rows.join(
        templates.withColumnRenamed("k", "t_k").withColumnRenamed("gram", "t_gram").withColumnRenamed("n_words", "t_words"), "h", "left"
    ).where(F.col("gram").isNull() | (F.col("gram") == F.col("t_gram")) | F.col("t_gram").isNull())
    # One shuffle by row serves the diagonals, the spans and the documents. Rows without a match stay as one entry.
    votes = votes.groupBy("row", "doc_id", "n_words", "template", "label", "is_phrase", "t_words", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.collect_set(F.when(F.col("template").isNotNull(), F.struct("at", "t_at", F.col("k").alias("k")))).alias("places")
    )
    votes = votes.repartition(common.partitions(docs.sparkSession), "row")
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.when((F.col("diagonal") - F.lag("diagonal").over(by_diagonal)) <= gap, 0).otherwise(1)
    votes = votes.withColumn("span", F.when(F.col("is_phrase"), F.col("diagonal").cast("long")).otherwise(F.sum(new).over(by_diagonal)))
    spans = votes.groupBy(
        "row", "doc_id", "n_words", "template", "label", "is_phrase", "t_words", "span"
    ).agg(F.flatten(F.collect_list("places")).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["t_at"], p["t_at"] + p["k"] - 1)))))
    first = F.array_min(F.transform("places", lambda p: p["at"]))
    last = F.array_max(F.transform("places", lambda p: p["at"] + p["k"] - 1))
    spans = spans.select(
        "row",
        "doc_id",
        "n_words",
        "label",
        "is_phrase",
        first.cast("long").alias("first"),
        last.cast("long").alias("last"),
        (covered / F.col("t_words")).alias("share")
    )
    verified = ~F.col("is_phrase") & (F.col("share") >= least_share)
    base = F.col("is_phrase")
    listed = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"), F.min(
                F.when(base, F.col("first"))
            ).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"), listed(base).alias("base_labels"), listed(base | verified).alias("labels"),
            F.coalesce(
                F.max(F.when(verified, F.col("share"))), F.max(F.when(base, F.lit(0.5))), F.lit(0.0)
            ).alias("score"), F.array_sort(F.collect_list(F.when(verified, F.struct("label", "first", "last", "share")))).alias("spans"),
        )
        .drop("row")
    )
