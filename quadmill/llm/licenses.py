"""Licence scans: word k-gram hashes vote for diagonals of licence templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, count_alnum_words, own_names

K = 3
#: Diagonals so many words apart belong to one alignment: words were put in or left out.
DRIFT = 3
#: Part of a template's words that an alignment must cover.
COVER = 0.8

#: (phrase, label) that always count, wherever the words stand consecutively.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, notice), as words. Notices are the customary ones.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("reserved", "all rights reserved"),
)


def gram_key(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(K)])


def template_grams(spark, templates=TEMPLATES) -> DataFrame:
    """(key, gram, template, label, tpos, tlen), a row for each k-gram of each template. Templates of fewer than K words are refused."""
    rows = []
    for i, (label, notice) in enumerate(templates):
        words = notice.split()
        if len(words) < K:
            raise ValueError(f"template of fewer than {K} words: {notice}")
        rows += [(i, label, p, len(words), words[p : p + K]) for p in range(len(words) - K + 1)]
    df = spark.createDataFrame(rows, "template int, label string, tpos int, tlen int, gram array<string>")
    return df.withColumn("key", gram_key(F.col("gram"), F.lit(0)))


def alignments(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, h, template, label, start, end, votes, score): verified spans of templates in texts, h the text's hash.

    Every rolling k-gram of every text is joined with the template positions by hash, and its words compared. Hits
    vote for the diagonal (word position less template position); diagonals within DRIFT of the one before are merged, and the
    merged alignment's template words are counted once each. Those that cover COVER of the template remain. A
    document's rows that hit nothing leave before the shuffle; what remains is bounded by its own licence text.
    """
    grams = F.broadcast(template_grams(docs.sparkSession, templates))  # as large as the templates given
    text = docs.select("doc_id", F.xxhash64("text").alias("h"), alnum_words(F.col("text")).alias("words"))
    each = text.select("doc_id", "h", "words", F.posexplode("words").alias("pos", "word"))
    each = each.select("doc_id", "h", "words", "pos", gram_key(F.col("words"), F.col("pos")).alias("key"))
    hits = each.join(grams, "key").where(F.slice("words", F.col("pos") + 1, K) == F.col("gram"))
    hits = hits.select("doc_id", "h", "template", "label", "tlen", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diag"))
    diagonals = hits.groupBy("doc_id", "h", "template", "label", "tlen", "diag").agg(F.collect_set("tpos").alias("tpos"))
    order = Window.partitionBy("doc_id", "h", "template").orderBy("diag")
    diagonals = diagonals.withColumn("new", F.when(F.col("diag") - F.lag("diag").over(order) <= DRIFT, 0).otherwise(1))
    merged = diagonals.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "h", "template", "label", "tlen", "run").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("t"), F.min(F.col("diag") + F.array_min("tpos")).alias("start"), F.max(F.col("diag") + F.array_max("tpos") + K).alias("end")
    )
    words = F.aggregate(F.transform("t", lambda p, i: F.least(F.lit(K), F.coalesce(F.get("t", i + 1) - p, F.lit(K)))), F.lit(0), lambda a, x: a + x)
    merged = merged.withColumns({"votes": F.size("t"), "score": words / F.col("tlen")})
    return merged.where(F.col("score") >= COVER).drop("t", "run", "tlen")


def base_places(words: Column) -> Column:
    """(at, label) of every phrase among the words."""
    def starts(w: Column, i: Column) -> Column:
        found = []
        for phrase, _ in PHRASES:
            p = phrase.split()
            same = F.coalesce(F.get(words, i) == p[0], F.lit(False))
            for j, x in enumerate(p[1:], 1):
                same = same & F.coalesce(F.get(words, i + j) == x, F.lit(False))
            found.append(F.when(same, F.struct(i.alias("at"), F.lit(dict(PHRASES)[phrase]).alias("label"))))
        return F.coalesce(*found)

    return F.filter(F.transform(words, starts), lambda x: x.isNotNull())


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base: places where a phrase's words stand consecutively, counted from word 0. labels adds those of verified
    template spans; score is 1 where a phrase stands, else the best span's covered part of its template, else 0. Null
    and empty texts have no words and no labels. Repeated rows are judged alike; columns of the new names are replaced and
    those that begin with an underscore left out.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = own_names(docs).drop(*new)
    spans = alignments(docs, templates)
    per = spans.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("label").alias("_more"), F.max("score").alias("_best"))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(F.contains(ascii_lower(text), F.lit("license")), alnum_words(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumns({"n_words": count_alnum_words(text), "_text": F.xxhash64("text"), "_words": words})
    rows = rows.withColumn("_places", base_places(F.col("_words"))).drop("_words")
    out = rows.join(per, rows.doc_id.eqNullSafe(per._id) & (rows._text == per._h), "left")
    base = F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"])))
    more = F.coalesce("_more", F.array().cast("array<string>"))
    out = out.withColumns(
        {
            "n_base": F.size("_places").cast("long"),
            "first_word": F.array_min(F.transform("_places", lambda p: p["at"])).cast("long"),
            "last_word": F.array_max(F.transform("_places", lambda p: p["at"])).cast("long"),
            "base_labels": F.array_join(base, ","),
            "labels": F.array_join(F.array_sort(F.array_union(base, more)), ","),
            "score": F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))),
        }
    )
    return out.drop("_id", "_h", "_more", "_best", "_text", "_places")
