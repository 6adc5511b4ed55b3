"""License scans by diagonal voting, on DataFrame functions only.

Every template is a word sequence.  All rolling word bigrams of a document are
hashed and joined to the bigrams' positions in the templates; a match votes for
the diagonal (document position - template position).  Votes are summed by
document, template and diagonal.  From each diagonal on, those at most DRIFT
farther (some words more) are merged to a span, whose places are thus about a
template's length wide.  A span is verified by the longest row of its votes in
which the positions in the template and the places in the document both rise:
the share of the template's positions in it counts, so that the same words in
another order, or scattered, do not make a license.

Base phrases need every position on a single diagonal, which makes them exact
places; longer templates, the operator's own, need SHARE of their positions.
Templates are constants of this module or a table (label, text), which is
broadcast only while it is small.

Defined results: null and empty texts have no words, no labels and score 0; a
template of fewer than two words is never found; very long texts are whole, a row
for each of their matches; equal doc_ids are separate rows; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, small, staged, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE, DRIFT = 0.8, 3

# Base phrases with their labels, and passages of public licenses and of the usual notices that name them.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work has been released into the public domain", "public-domain"),
    ("the software is provided as is without warranty of any kind express or implied", "warranty"),
)


def _words(text) -> F.Column:
    """A-Z folded; lower() makes an ASCII letter of one other character, the Kelvin sign, so a private one takes its place."""
    text = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


#: The hash of each two consecutive words of the column w.
GRAMS = "transform(slice(w, 2, size(w)), (x, i) -> xxhash64(w[i], x))"


#: For each vote of the column near, in the document's order, the longest row that ends with it.
RISING = """aggregate(array_sort(near), cast(array() AS array<struct<i:bigint,at:int,n:int>>), (done, v) -> concat(done, array(named_struct(
    'i', v.i, 'at', v.at, 'n', 1 + coalesce(array_max(transform(filter(done, x -> x.i < v.i AND x.at < v.at), x -> x.n)), 0)))))"""


def _index(rows: DataFrame) -> DataFrame:
    """(template, label, is_base, size, at, h): the bigrams of rows(template, label, is_base, w)."""
    return rows.filter("size(w) > 1").select("template", "label", "is_base", (F.size("w") - 1).alias("size"), F.posexplode(F.expr(GRAMS)).alias("at", "h"))


def scan(docs: DataFrame, base: tuple = BASE, templates: tuple | DataFrame = TEMPLATES, share: float = SHARE) -> DataFrame:
    """(rid, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs(doc_id, text); templates: (text, label) pairs, or a table with these columns."""
    spark = docs.sparkSession
    more = () if isinstance(templates, DataFrame) else templates
    fixed = spark.createDataFrame([(str(n), label, n < len(base), text.split()) for n, (text, label) in enumerate((*base, *more))], "template string, label string, is_base boolean, w array<string>")
    grams = F.broadcast(_index(fixed))
    if isinstance(templates, DataFrame):
        named = templates.select(F.concat(F.lit("t"), F.sha2("text", 256)).alias("template"), F.col("label").cast("string").alias("label"), F.lit(False).alias("is_base"), _words(F.col("text")).alias("w"))
        grams = small(staged(_index(fixed.unionByName(named.dropDuplicates(["template", "label"])))))
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("w"))
    # the leading null stands for the document itself, so that one pass also counts the words
    pairs = words.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("long")), F.expr(GRAMS))).alias("i", "h"))
    found = pairs.join(grams, "h", "left").filter("h IS NULL OR template IS NOT NULL")
    each = ["rid", "doc_id", "n_words", "template", "label", "is_base", "size"]
    votes = found.groupBy(*each, (F.col("i") - 1 - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_list("at")).alias("at"))
    # a longer template's span holds the diagonals that begin at most DRIFT behind its own; a base phrase keeps its own
    by = Window.partitionBy("rid", "doc_id", "template", "label").orderBy("diagonal").rangeBetween(0, DRIFT)
    own = votes.withColumn("own", F.when(~F.col("is_base"), F.transform("at", lambda a: F.struct((F.col("diagonal") + a).alias("i"), a.alias("at")))))
    near = own.withColumn("near", F.flatten(F.collect_list("own").over(by)))
    rising = F.coalesce(F.array_max(F.transform(F.expr(RISING), lambda x: x["n"])), F.lit(0))
    spans = near.select(*each, F.when(F.col("is_base"), F.size("at")).otherwise(rising).alias("votes"), (F.col("diagonal") + F.element_at(F.col("at"), 1)).alias("low"))
    part = F.when(F.col("size") > 0, F.col("votes") / F.col("size"))
    kept = spans.withColumn("part", F.coalesce(part, F.lit(0.0))).withColumn("ok", F.coalesce(F.when(F.col("is_base"), F.col("votes") == F.col("size")).otherwise(F.col("part") >= share), F.lit(False)))
    based = F.col("ok") & F.col("is_base")
    return kept.groupBy("rid", "doc_id", "n_words").agg(
        F.sum(F.when(based, 1).otherwise(0)).cast("long").alias("n_base"), F.min(F.when(based, F.col("low"))).cast("long").alias("first_word"), F.max(F.when(based, F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(based, F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("ok") | ~F.col("is_base"), F.col("part")).otherwise(0.0)).alias("score"),
    )


def op10_diagonal_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(columns(table(spark, sf_dir, "documents"), doc_id="long", text="string")).drop("rid")
