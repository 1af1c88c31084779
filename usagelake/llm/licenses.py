"""License scans by diagonal voting, in DataFrame functions only.

A template is a word sequence: a phrase that must stand whole, or a longer text of which a share must be found. All
rolling word k-gram hashes of the documents (k = 1 or 2 for phrases, 5 for long texts) are joined to template positions
in a broadcast table, whose size is that of the template list. A hit's document position less its template position is
its diagonal. Votes are added up for each document, template and diagonal; neighbouring diagonals (an inserted or a lost
word moves the diagonal by one) are merged; and a merged span counts if the words it covers reach the template's share.
Hits compare the words themselves, so equal hashes of different words make none.

Only hits and one row for each document are shuffled. No text is.

Defined cases: a null text is empty; an empty text has no words, no labels and score 0; repeated rows are scanned one by
one; overlapping places all count; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import ascii_lower, keyed, whole_text

#: Words of lower-cased texts stand between these.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_K, TEXT_K = 2, 5


@dataclass(frozen=True)
class Template:
    """share: of its words that a span must cover (1: the phrase whole). base: its places count as base ones."""

    label: str
    text: str
    share: float = 1.0
    base: bool = False


#: Phrases of the base labels, and opening sentences of public licenses.
TEMPLATES = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 0.8),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", 0.8),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.8),
]


def scan_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")


def _grams(spark: SparkSession, templates: list[Template], max_words: int) -> DataFrame:
    """A row for each distinct k-gram of the templates with all its places there."""
    if sum(len(t.text.split()) for t in templates) > max_words:
        raise ValueError(f"the templates have more than {max_words} words, the bound of what is broadcast")
    rows = []
    for t, x in enumerate(templates):
        words = x.text.split()
        k = PHRASE_K if x.share == 1.0 else TEXT_K
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {x.text!r}")
        rows += [(k, words[i : i + k], t, i, len(words), x.share, x.base, x.label) for i in range(len(words) - k + 1)]
    table = spark.createDataFrame(rows, "k int, gram array<string>, t int, at int, length int, share double, base boolean, label string")
    return table.groupBy("k", "gram").agg(F.collect_list(F.struct("t", "at", "length", "share", "base", "label")).alias("places"))


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text", slack: int = 2, max_words: int = 200_000) -> DataFrame:
    """For each row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start and end word).

    slack: how far apart diagonals may be that are merged. score: the largest covered share of a template in an accepted span."""
    templates = TEMPLATES if templates is None else templates
    grams = _grams(docs.sparkSession, templates, max_words)
    short, long = (F.broadcast(grams.where(F.col("k") == k).select(F.hash("gram").alias(f"h{k}"), F.col("gram").alias(f"g{k}"), F.col("places").alias(f"p{k}"))) for k in (PHRASE_K, TEXT_K))
    # One row for each place and one (pos -1) that carries the document itself, so that the text is read once.
    place = lambda w, i, words: F.struct(
        i.alias("pos"), F.hash(F.slice(words, i + 1, PHRASE_K)).alias("h2"), F.hash(F.slice(words, i + 1, TEXT_K)).alias("h5"), F.slice(words, i + 1, TEXT_K).alias("gram"), F.lit(0).alias("n")
    )
    own = lambda words: F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("h2"), F.lit(None).cast("int").alias("h5"), F.lit(None).cast("array<string>").alias("gram"), F.size(words).alias("n")))
    every = F.transform(F.array(scan_words(whole_text("__0"))), lambda words: F.concat(own(words), F.transform(words, lambda w, i: place(w, i, words))))[0]
    rows = keyed(docs, id_col, text_col).select("__row", "__id", F.explode(every).alias("x")).select("__row", "__id", "x.*")
    rows = rows.join(short, rows["h2"] == short["h2"], "left").drop(short["h2"]).join(long, rows["h5"] == long["h5"], "left").drop(long["h5"])
    hit2 = F.when(F.slice("gram", 1, PHRASE_K) == F.col("g2"), F.col("p2"))
    hit5 = F.when(F.col("gram") == F.col("g5"), F.col("p5"))
    none = F.array().cast(grams.schema["places"].dataType)
    places = F.concat(F.coalesce(hit2, none), F.coalesce(hit5, none))
    rows = rows.where((F.col("pos") < 0) | (F.size(places) > 0)).select("__row", "__id", "pos", "n", F.explode_outer(places).alias("p"))
    votes = rows.groupBy("__row", "__id", F.col("p.t").alias("t"), (F.col("pos") - F.col("p.at")).alias("diagonal"), F.when(F.col("p").isNull(), F.col("n")).alias("n")).agg(
        F.first("p").alias("p"), F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("pos").alias("at")
    )
    per_doc = votes.groupBy("__row", "__id").agg(
        F.max("n").cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "diagonal", "first", "last", "at", F.col("p.length").alias("length"), F.col("p.share").alias("share"), F.col("p.base").alias("base"), F.col("p.label").alias("label"))))).alias("d"),
    )
    return _verify(per_doc, slack).withColumnRenamed("__id", id_col)


def _verify(per_doc: DataFrame, slack: int) -> DataFrame:
    """Merges neighbouring diagonals, keeps the spans that cover enough of their template, and adds up."""
    span = "array<struct<t:int,diagonal:int,first:int,last:int,at:array<int>,length:int,share:double,base:boolean,label:string>>"
    d = F.col("d").cast(span)
    # d is sorted by template and diagonal. A long template's diagonal joins the span before it if near enough.
    joins = lambda a, x: (x["share"] < 1) & (a["t"] == x["t"]) & (x["diagonal"] - a["diagonal"] <= slack) & (F.abs(x["first"] - a["last"]) <= a["length"])
    both = lambda a, x: F.struct(x["t"].alias("t"), x["diagonal"].alias("diagonal"), F.least(a["first"], x["first"]).alias("first"), F.greatest(a["last"], x["last"]).alias("last"), F.array_union(a["at"], x["at"]).alias("at"), x["length"].alias("length"), x["share"].alias("share"), x["base"].alias("base"), x["label"].alias("label"))
    step = lambda acc, x: F.when(F.coalesce(joins(F.element_at(acc, -1), x), F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both(F.element_at(acc, -1), x)))).otherwise(F.concat(acc, F.array(x)))
    exact = F.filter(d, lambda x: x["share"] == 1)
    merged = F.aggregate(F.filter(d, lambda x: x["share"] < 1), F.array().cast(span), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)))
    # A span's words: those of its hits' k-grams, each once.
    covered = lambda x, k: F.aggregate(F.sort_array(x["at"]), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + k - F.greatest(p, a["end"])).alias("n"), (p + k).alias("end")), lambda a: a["n"])
    row = lambda x, k: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["first"].alias("start"), (x["last"] + k).alias("end"), F.least(F.lit(1.0), covered(x, k) / x["length"]).alias("cover"), x["share"].alias("share"))
    spans = F.concat(F.transform(exact, lambda x: row(x, F.lit(PHRASE_K))), F.transform(merged, lambda x: row(x, F.lit(TEXT_K))))
    ok = per_doc.select("__id", "n_words", F.filter(spans, lambda s: s["cover"] >= s["share"]).alias("spans"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: s["start"].cast("long"))
    names = lambda only: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s["base"]) if only else F.col("spans"), lambda s: s["label"]))), ",")
    return ok.select(
        "__id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        names(True).alias("base_labels"), names(False).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("spans"),
    )
