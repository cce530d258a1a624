"""License scans by voting on diagonals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that no word holds, after A-Z is lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Wordings of public license notices, and their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
]


def template_grams(spark: SparkSession, templates: list[tuple[int, str]]) -> DataFrame:
    """(template, size, tpos, gram, gh): every rolling K-gram of each template with its position. A template has K words or more."""
    rows = []
    for t, text in templates:
        w = text.split(" ")
        assert len(w) >= K, text
        rows += [(t, len(w) - K + 1, i, " ".join(w[i : i + K])) for i in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "template int, size int, tpos int, gram string")
    return df.withColumn("gh", F.xxhash64("gram"))


def license_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, drift: int = 3, least: float = 0.6) -> DataFrame:
    """One row per document with the license wordings found in it.

    Every K-gram of words is joined by hash to the templates' grams (and its
    text compared), votes are summed by (template, offset diagonal), diagonals
    at most ``drift`` apart whose places touch are merged, and a merged span is verified by the share of
    the template's grams that it holds in their order, repeats not counted. Phrases need every gram on one diagonal.
    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans (label, start, coverage of the notices).

    Null and empty texts, and texts under K words, have no place: n_base 0, null
    first and last word, empty labels, score 0. Rows repeating doc_id and text get the same result each.
    """
    spark = docs.sparkSession
    names = [*phrases, *notices]
    grams = template_grams(spark, [(i, t) for i, (t, _) in enumerate(names)])
    label = F.element_at(F.array(*[F.lit(x) for _, x in names]), F.col("template") + 1)
    n_phrases = len(phrases)

    # the Kelvin sign is the one letter outside ASCII whose lower case is a plain letter
    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "K", "�"))
    x = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).alias("rk"), F.split(text, NOT_WORD).alias("w"))
    x = x.withColumn("w", F.filter("w", lambda v: v != ""))
    rolled = F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (v, i) -> concat_ws(' ', v, w[i + 1], w[i + 2]))")
    one = x.select("rk", F.posexplode(rolled).alias("pos", "gram")).withColumn("gh", F.xxhash64("gram"))
    g = F.broadcast(grams.withColumnRenamed("gram", "tgram"))  # fixed templates: a few hundred rows
    hits = one.join(g, "gh").filter(F.col("gram") == F.col("tgram")).select("rk", "template", "size", "tpos", "pos")
    # rows that repeat a document are one row key: each of its hits counts once
    votes = hits.distinct().groupBy("rk", "template", "size", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_list(F.struct("pos", "tpos")).alias("at"))
    base = votes.filter((F.col("template") < n_phrases) & (F.col("votes") == F.col("size")))
    base = base.groupBy(F.col("rk").alias("b_rk")).agg(F.count("*").alias("n_base"), F.min("diag").alias("first_word"), F.max("diag").alias("last_word"), F.array_sort(F.collect_set(label)).alias("base_labels"))
    w = Window.partitionBy("rk", "template").orderBy("diag", "lo")
    apart = (F.col("diag") - F.lag("diag").over(w) > drift) | (F.col("lo") - F.lag("hi").over(w) > F.col("size"))
    spans = votes.filter(F.col("template") >= n_phrases).withColumn("run", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(w))
    spans = spans.groupBy("rk", "template", "size", "run").agg(F.flatten(F.collect_list("at")).alias("at"), F.min("lo").alias("start"))
    # places of the template in its order, each once: those beyond all that stand before
    spans = spans.withColumn("places", F.expr("aggregate(array_sort(at), struct(-1 as most, 0 as n), (a, x) -> if(x.tpos > a.most, struct(x.tpos as most, a.n + 1 as n), a), a -> a.n)"))
    spans = spans.withColumn("coverage", F.col("places") / F.col("size"))
    full = F.max("coverage")
    found = spans.groupBy(F.col("rk").alias("s_rk")).agg(
        F.array_sort(F.collect_set(F.when(F.col("coverage") >= least, label))).alias("more"), full.alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("coverage") >= least, F.struct(label.alias("label"), F.col("start"), F.col("coverage"))))).alias("spans"),
    )
    out = x.select("doc_id", "rk", F.size("w").cast("long").alias("n_words"))
    out = out.join(base, out["rk"] == base["b_rk"], "left").join(found, out["rk"] == found["s_rk"], "left")
    empty = F.array().cast("array<string>")
    bl = F.coalesce("base_labels", empty)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(bl, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(bl, F.coalesce("more", empty))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans",
    )
