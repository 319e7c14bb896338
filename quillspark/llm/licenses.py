"""License scans by diagonal voting, in DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._common import lower_ascii, staged, word_grams

#: A phrase and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public license notices by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
)

GRAM_WORDS = 4
#: Diagonals so near each other count as one span; a span needs so large a share of the template's k-grams.
DIAGONAL_GAP, COVERAGE = 3, 0.6
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words after A-Z are lower-cased: runs of characters but ASCII other than letters and digits; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def phrase_places(words: Column, padded: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """For each phrase the array of word indices where it starts; padded is the words with spaces between and around."""

    def starts(phrase: str) -> Column:
        parts = phrase.split(" ")
        at = lambda i: reduce(lambda a, b: a & b, (F.get(words, i + j) == F.lit(w) for j, w in enumerate(parts)))
        last = F.size(words) - len(parts)
        return F.when(padded.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<int>"))

    return {p: starts(p) for p in phrases}


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template, label, words) of the templates."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), words_of(F.lit(text)).alias("words")) for i, (label, text) in enumerate(templates)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def find_spans(docs: DataFrame, templates: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, gap: int = DIAGONAL_GAP, coverage: float = COVERAGE) -> DataFrame:
    """(id, text_key, label, template, first_word, last_word, coverage) for each template found in a document.

    All rolling hashes of gram_words words are joined to the positions of the templates' and
    verified word by word. A hit votes for its diagonal, the place in the text where the template
    would start. Votes are summed by (document, template, diagonal) before anything else, so a
    frequent k-gram costs a row a document. Diagonals at most `gap` apart are one span; coverage is
    the share of the template's k-grams that the span has, and spans below `coverage` go.

    Documents are told apart by id and xxhash64 of the text, repeated rows give one result, null and
    empty texts none. Templates of fewer words than a k-gram are one gram of all their words; those without words are never found.
    """
    templates = templates.where(F.size("words") > 0).withColumns({"n_template": F.size("words"), "k": F.least(F.size("words"), F.lit(gram_words))})
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    found = []
    for k in sorted(r["k"] for r in templates.select("k").distinct().collect()) or [gram_words]:
        gram = F.concat_ws(" ", *(F.get("part", F.col("at") + j) for j in range(k)))
        grams = word_grams(templates.where(F.col("k") == k), k, ["template", "label", "n_template", "k"]).select("template", "label", "n_template", "k", F.col("pos").alias("place"), "h", gram.alias("gram"))
        grams = F.broadcast(grams) if grams.count() <= BROADCAST_ROWS else grams
        hits = word_grams(texts, k, ["id", "text_key"]).join(grams, "h").where(gram == F.col("gram"))
        found.append(hits.select("id", "text_key", "template", "label", "n_template", "k", "pos", F.col("place").alias("at")))
    hits = reduce(DataFrame.union, found)
    key = ["id", "text_key", "template", "label", "n_template", "k"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True)).cast("int")
    spans = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    merged = spans.groupBy(*key, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    share = F.col("n") / (F.col("n_template") - F.col("k") + 1)
    return merged.select("id", "text_key", "label", "template", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + F.col("k") - 1).cast("long").alias("last_word"), share.alias("coverage")).where(F.col("coverage") >= coverage)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row for every row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places where a phrase's words stand in a row, first_word and last_word are the
    smallest and largest of their starts (null without any). labels also has those of the templates
    found by find_spans(), whose spans (label, first and last word, coverage) come along. score is 1
    with a phrase, else the best coverage, else 0. Labels are distinct, sorted and joined by commas;
    none is the empty string. Null and empty texts have no words. Other columns are not read.
    """
    phrases = phrases or PHRASES
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    texts = texts.withColumn("padded", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    places = phrase_places(F.col("words"), F.col("padded"), phrases)
    base = texts.select("id", "text_key", F.size("words").cast("long").alias("n_words"), *(c.alias(f"p{i}") for i, c in enumerate(places.values())))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(phrases))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    base = base.select("id", "text_key", "n_words", every.alias("every"), F.array_distinct(labels).alias("base"))
    spans = find_spans(docs, template_table(docs.sparkSession, templates), id_col=id_col, text_col=text_col)
    found = staged(spans.groupBy("id", "text_key").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"), F.sort_array(F.collect_list(F.struct("first_word", "last_word", "label", "coverage"))).alias("spans")), "licenses")
    found = found.withColumnsRenamed({"id": "_id", "text_key": "_key"})
    out = base.join(found, base["id"].eqNullSafe(found["_id"]) & (base["text_key"] == found["_key"]), "left")
    text = lambda c: F.array_join(F.sort_array(c), ",")
    return out.select(
        "id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        text(F.col("base")).alias("base_labels"),
        text(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first_word:bigint,last_word:bigint,label:string,coverage:double>>")).alias("spans"),
    )
