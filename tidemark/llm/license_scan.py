"""License scan by diagonal voting.

All rolling word k-grams of every text are hashed. A gram whose hash no template position has cannot join, so it is dropped in
its task, where the hashes of the constant template table are known; Spark joins the others to template positions on hash and
words. A joined gram votes for the diagonal (its position minus the template position) of its template. Votes are counted per
diagonal; a base phrase stands where its diagonal holds all of its grams. Neighbouring diagonals of one template (a word too
many or too few in between) are merged into chains, and the densest stretch of a chain, no longer than the template with words in
between, is verified by the share of template grams it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bytetext import ALNUM, Rolling, mix, hash_words, signed, slices, split_words
from tidemark.llm.storage import materialize

#: Phrases and the labels they give.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening passages of common licenses, by the label the method adds.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "boost": "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
}
GRAM, SHORT_GRAM = 3, 2
#: Diagonals this far apart are neighbours; a stretch needs this share of the template's grams, and beside the template's words may
#: hold this share of them again (and twice the drift) as words in between.
DRIFT = 3
COVERAGE = 0.7
BETWEEN = 0.5


def template_rows() -> list[tuple[str, str, bool, int, int, int, str]]:
    """template, label, base, position, gram size, grams in the template, gram."""
    rows = []
    for base, table in ((True, {v: k for k, v in BASE.items()}), (False, TEMPLATES)):
        for label, text in table.items():
            words = split_words(text, ALNUM, True)
            k = SHORT_GRAM if base else min(GRAM, len(words))
            n = len(words) - k + 1
            rows += [(f"{'base' if base else 'text'}:{label}", label, base, i, k, n, b" ".join(words[i : i + k]).decode()) for i in range(n)]
    return rows


def gram_hash(gram: str) -> int:
    h = hash_words([w.encode() for w in gram.split(" ")])
    return int(signed(_roll(h, len(h)))[0])


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    at = np.arange(len(h) - k + 1)
    return Rolling(mix(h)).of(at, at + k)


GRAM_TYPE = pa.struct([pa.field("p", pa.int32()), pa.field("k", pa.int32()), pa.field("h", pa.int64()), pa.field("g", pa.string())])


def _gram_rows(wanted: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            ids, key = batch.column(0), batch.column(1)
            for part in slices(batch.column(2), ALNUM, True):
                h = part.hashes()
                rows, found = [np.zeros(0, dtype=np.int64)], []
                row_of = np.repeat(np.arange(part.rows), part.counts())
                for k, hashes in wanted.items():
                    if len(h) < k:
                        continue
                    g = signed(_roll(h, k))
                    at = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
                    i = np.flatnonzero((hashes[at] == g) & (row_of[: len(g)] == row_of[k - 1 :]))
                    rows.append(row_of[i])
                    found += [(int(x - part.first[r]), k, int(y), b" ".join(part.word(j) for j in range(x, x + k)).decode()) for x, r, y in zip(i.tolist(), row_of[i].tolist(), g[i].tolist(), strict=True)]
                row = np.concatenate(rows)
                order = np.argsort(row, kind="stable")
                found = [found[i] for i in order.tolist()]
                values = pa.StructArray.from_arrays([pa.array([f[j] for f in found], GRAM_TYPE[j].type) for j in range(4)], fields=list(GRAM_TYPE))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(part.row, part.rows), key.slice(part.row, part.rows), pa.array(part.counts()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "key", "n_words", "grams"])

    return run


def templates(spark: SparkSession) -> DataFrame:
    """The template table: a few hundred rows whatever the corpus."""
    rows = [(*r, gram_hash(r[-1])) for r in template_rows()]
    return spark.createDataFrame(rows, "template string, label string, base boolean, at int, k int, grams int, g string, h long")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and license passages of each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest verified share of a template, 1 for a base phrase, 0 without any. One row per input row, repeated
    rows included. A passage with at most ``BETWEEN`` of a template's words inserted counts. Null and empty texts have no words, null
    places and empty labels. Null ids stay null. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64("text", "id").alias("b")).alias("key"), "text")
    table = [(r[4], gram_hash(r[-1])) for r in template_rows()]
    wanted = {k: np.unique(np.array([h for x, h in table if x == k], dtype=np.int64)) for k in sorted({k for k, _ in table})}
    grams = materialize(src.mapInArrow(_gram_rows(wanted), "id long, key struct<a:long,b:long>, n_words long, grams array<struct<p:int,k:int,h:long,g:string>>"), "grams")
    met = grams.where(F.size("grams") > 0).dropDuplicates(["key"]).select("key", F.explode("grams").alias("x")).select("key", "x.*")
    votes = met.join(F.broadcast(templates(docs.sparkSession)), ["h", "g", "k"])
    diagonal = votes.groupBy("key", "template", "label", "base", "grams", (F.col("p") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.collect_set("at").alias("held"))
    base = diagonal.where("base and votes = grams").groupBy("key").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    order = W.partitionBy("key", "template").orderBy("diagonal")
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True)).cast("int")
    merged = diagonal.where("not base").withColumn("near", near).withColumn("group", F.sum("near").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # The densest stretch of a chain, no longer than a quotation with words in between: fragments around it count for nothing.
    length = (1 + BETWEEN) * F.col("grams") + 2 * DRIFT
    longest = int((1 + BETWEEN) * max(r[5] for r in template_rows() if not r[2]) + 2 * DRIFT)
    ahead = W.partitionBy("key", "template", "group").orderBy("p").rangeBetween(0, longest)
    voted = merged.select("key", "template", "label", "grams", "group", F.explode("held").alias("at"), "diagonal").withColumn("p", F.col("diagonal") + F.col("at"))
    dense = voted.withColumn("ahead", F.collect_list(F.struct("p", "at")).over(ahead)).withColumn("ahead", F.filter("ahead", lambda x: x["p"] - F.col("p") < length))
    spans = dense.groupBy("key", "template", "label", "grams", "group").agg(F.max(F.size(F.array_distinct(F.transform("ahead", lambda x: x["at"])))).alias("n"))
    spans = spans.withColumn("share", F.col("n") / F.col("grams")).where(F.col("share") >= COVERAGE)
    text = spans.groupBy("key").agg(F.max("share").alias("share"), F.collect_set("label").alias("text_set"))
    out = grams.select("id", "key", "n_words").join(base, "key", "left").join(text, "key", "left")
    none = F.array().cast("array<string>")
    base_set, text_set = F.coalesce("base_set", none), F.coalesce("text_set", none)
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, text_set)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
