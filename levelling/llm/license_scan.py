"""License phrases and notices in documents, by diagonal voting (operator 11, native).

Only DataFrame functions work on rows here.  Texts become lower-cased words
(A-Z only; words are runs of ASCII letters, digits and any other characters
beyond ASCII).

1. Rolling grams: every word with its successors becomes one row, joined by the
   hash of its first two words to the places in all templates where these words
   stand (a third word, where the template has one, is compared in the join
   condition, so frequent pairs of words give no rows).  The template table is
   broadcast while it has at most ``BROADCAST_GRAMS`` rows and shuffled beyond.
   Each document adds one row of its own that always finds a partner and brings
   its number of words along: texts are read once, documents without a match
   cost one narrow row.
2. Votes: matches are counted by document, template and diagonal (place in the
   document minus place in the template), with partial counts before the
   shuffle.
3. A phrase (``exact`` template) stands where a diagonal holds all its grams.
4. For notices, neighbouring diagonals (at most ``n / 10`` words apart, one at
   least) are merged: words were left out or put in.  A merged group with
   ``MIN_VOTES`` of the template's grams becomes a span.
5. Spans are verified on the words of the document itself: similarity is 1 minus
   the edit distance of span and template over the longer one's length, and has
   to reach ``least``.  Only the texts of documents with spans are read again
   (a filter by id bucket, a table of at most ``BUCKETS`` rows, comes before the
   shuffle).  Of verified spans that overlap the most similar one stays.

A document's diagonals are sorted within the document (by windows over document
and template); no group goes beyond one document.  Every output column is a
count, a place or a label, and nothing but the number of template grams reaches
the driver.

Defined results: null texts count as empty; texts without words have no places
and score 0; rows that repeat an id are documents of their own, rows that repeat
id and text give equal rows; a null id stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_GRAMS = 50_000
BUCKETS = 1 << 18
MIN_VOTES = 0.25
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Phrases of the contract and their labels: fixed values.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Wording of public licenses as it stands in files: fixed values.
NOTICES = [
    ("agpl", "GNU Affero General Public License version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under "
                   "the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``label, exact, words`` of phrases and notices."""
    rows = [(label, True, text) for label, text in phrases] + [(label, False, text) for label, text in notices]
    array = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(e).alias("exact"), F.lit(t).alias("text"))
                      for a, e, t in rows])
    return spark.range(1).select(F.inline(array)).select("label", "exact", words(F.col("text")).alias("words"))


def _triples(w: str) -> Column:
    """Per word the word and its two successors (null beyond the end)."""
    n = F.size(w)
    return F.arrays_zip(F.col(w), F.slice(w, 2, n), F.slice(w, 3, n)).cast("array<struct<w1:string,w2:string,w3:string>>")


def _template_grams(found: DataFrame) -> DataFrame:
    """Grams of all templates: two words of a phrase, three of a notice; and the partner of a document's own row."""
    g = found.select("tpl", "exact", F.posexplode(_triples("words")).alias("tpos", "g")).select(
        "tpl", "tpos", F.col("g.w1").alias("t1"), F.col("g.w2").alias("t2"),
        F.when(~F.col("exact"), F.col("g.w3")).alias("t3"), "exact")
    g = g.where("t2 is not null and (exact or t3 is not null)").drop("exact")
    own = found.sparkSession.range(1).select(
        F.lit(-1).alias("tpl"), F.lit(0).alias("tpos"), F.lit("").alias("t1"), F.lit(None).cast("string").alias("t2"),
        F.lit(None).cast("string").alias("t3"))
    return g.unionByName(own).withColumn("h", F.xxhash64("t1", "t2"))


def matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, mark, n_words, tpl, at, tpos``: places of template grams (tpl -1: the document's own row)."""
    held = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), words(F.col("text")).alias("w"))
    none = F.lit(None).cast("string")
    own = F.array(F.struct(F.lit("").alias("w1"), none.alias("w2"), none.alias("w3")))
    rows = held.select("doc_id", "mark", F.size("w").alias("n_words"),
                       F.posexplode(F.concat(own, _triples("w"))).alias("pos", "g"))
    rows = rows.select("doc_id", "mark", "n_words", (F.col("pos") - 1).alias("at"), F.col("g.w1").alias("w1"),
                       F.col("g.w2").alias("w2"), F.col("g.w3").alias("w3"))
    rows = rows.withColumn("k", F.xxhash64("w1", "w2"))
    grams = stash(_template_grams(found), "grams")
    if grams.count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    same = ((F.col("k") == F.col("h")) & (F.col("w1") == F.col("t1"))
            & (F.col("t2").isNull() | (F.col("w2") == F.col("t2")))
            & (F.col("t3").isNull() | (F.col("w3") == F.col("t3"))))
    return rows.join(grams, same).select("doc_id", "mark", "n_words", "tpl", "at", "tpos")


def _same(a: str, b: str) -> Column:
    """The same document in both tables."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))


def _verified(docs: DataFrame, spans: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Spans whose words are close to their template, the best of those that overlap."""
    def bucket(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    near = spans.select(bucket("doc_id").alias("bucket")).distinct()
    asked = (docs.withColumn("bucket", bucket("doc_id")).join(F.broadcast(near), "bucket", "left_semi")
             .select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text").alias("d"))
    texts = asked.join(spans.select("doc_id", "mark").distinct().alias("s"), _same("d", "s"), "left_semi").select(
        "doc_id", "mark", words(F.col("text")).alias("w"))
    cut = F.array_join(F.slice(F.col("w"), F.col("first") + 1, F.col("end") - F.col("first")), " ")
    pairs = (spans.alias("s").join(texts.alias("x"), _same("s", "x"))
             .select("s.doc_id", "s.mark", "s.tpl", "first", "end", cut.alias("span")).distinct()
             .join(found.select(F.col("tpl").alias("t"), "label", F.array_join("words", " ").alias("model")),
                   F.col("tpl") == F.col("t")))
    alike = 1 - F.levenshtein("span", "model") / F.greatest(F.length("span"), F.length("model"))
    pairs = pairs.select("doc_id", "mark", "tpl", "label", "first", "end", alike.alias("similarity")).where(
        F.col("similarity") >= least)
    inside = Window.partitionBy("doc_id", "mark").orderBy("first", "end", "tpl")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("first") < F.col("reach"), 0).otherwise(1)).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = F.max(F.struct("similarity", (-F.col("tpl")).alias("tie"), "label", "first", "end")).alias("b")
    return (pairs.withColumn("reach", reach).withColumn("isle", isle).groupBy("doc_id", "mark", "isle").agg(best)
            .select("doc_id", "mark", "b.label", "b.first", "b.end", "b.similarity"))


def scan(docs: DataFrame, known: DataFrame, least: float = 0.85, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places, spans`` of every row, given templates (``label, exact, words``).

    ``places``: label and first word of every exact phrase; ``spans``: label,
    first word, end (exclusive) and similarity of every verified notice.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = stash(known.where("size(words) >= if(exact, 2, 3)").select("label", "exact", "words").distinct().select(
        F.row_number().over(Window.orderBy("label", "exact", "words")).alias("tpl"), "*",
        F.size("words").alias("n")), "templates")
    hits = stash(matches(docs, found), "matches")
    rows = hits.where("tpl = -1").groupBy("doc_id", "mark").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))
    votes = (hits.where("tpl >= 0").distinct()
             .groupBy("doc_id", "mark", "n_words", "tpl", (F.col("at") - F.col("tpos")).alias("diagonal"))
             .agg(F.count(F.lit(1)).alias("votes"))
             .join(found.select("tpl", "label", "exact", "n"), "tpl"))
    votes = stash(votes, "votes")
    places = votes.where("exact and votes = n - 1").groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_list(F.struct(F.col("diagonal").alias("start"), "label"))).alias("places"))
    along = Window.partitionBy("doc_id", "mark", "tpl").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    merged = (votes.where("not exact").withColumn("far", F.when(far, 1).otherwise(0))
              .withColumn("isle", F.sum("far").over(along))
              .groupBy("doc_id", "mark", "n_words", "tpl", "n", "isle")
              .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"))
              .where(F.col("votes") >= MIN_VOTES * (F.col("n") - 2)))
    spans = stash(merged.select("doc_id", "mark", "tpl", F.greatest(F.lit(0), "d0").alias("first"),
                                F.least("n_words", F.col("d1") + F.col("n")).alias("end")), "spans")
    spans = _verified(docs, spans, found, least).groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_list(F.struct("first", "end", "label", "similarity"))).alias("spans"))
    out = (rows.alias("r").join(places.alias("p"), _same("r", "p"), "left")
           .join(spans.alias("s"), _same("r", "s"), "left")
           .select("r.doc_id", "copies", F.col("n_words").cast("long").alias("n_words"),
                   F.coalesce("places", F.array().cast("array<struct<start:int,label:string>>")).alias("places"),
                   F.coalesce("spans", F.array().cast(
                       "array<struct<first:int,end:int,label:string,similarity:double>>")).alias("spans")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def report(found: DataFrame) -> DataFrame:
    """Counts, labels and score of ``scan``: the columns of the registered query.

    The score is 1 with an exact phrase, else the similarity of the best span, else 0.
    """
    base, more = F.col("places")["label"], F.col("spans")["label"]

    def listed(a: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places")["start"]).cast("long").alias("first_word"),
        F.array_max(F.col("places")["start"]).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max(F.col("spans")["similarity"]), F.lit(0.0))).alias("score"))
