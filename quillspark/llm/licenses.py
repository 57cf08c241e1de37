"""License notices found by diagonal voting.

All rolling hashes of k words are joined with the positions at which license
templates have them. A match at document word d and template word t votes for
the diagonal d - t; neighbouring diagonals merge (a word put in or left out
shifts the rest by one), and the span they mark is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.frames import WORD_BYTE, cut, fold, hashes, pieces, rolling, sized, spans, utf8

K, SLACK, MIN_SIMILARITY = 3, 3, 0.7
STEP_BYTES = 2 << 20
TEMPLATE_BYTES = 16 << 20

#: Notices as they stand in files and pages, by license. One license can have several.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def read_templates(table: DataFrame, license_col: str = "license", text_col: str = "text") -> list[tuple[str, str]]:
    """Templates of a table, by license and text; nulls are left out. All workers hold them, so more than TEMPLATE_BYTES of text are refused."""
    rows = table.select(F.col(license_col).cast("string").alias("license"), F.col(text_col).cast("string").alias("text")).dropna().distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates are more than {TEMPLATE_BYTES}")
    return [(r["license"], r["text"]) for r in rows.orderBy("license", "text").collect()]


def words_of(text: str) -> np.ndarray:
    """Hash of every word of one text, in lower case."""
    buf = fold(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = spans(buf, np.array([0, len(buf)]), WORD_BYTE)
    return hashes(buf, starts, ends)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the longest common subsequence over both lengths: 1 for equal words."""
    if not len(a) or not len(b):
        return 0.0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        # the usual recurrence, a row at a time: the maximum to the left comes last
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(new)
    return 2.0 * int(row[-1]) / (len(a) + len(b))


def postings(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int]]:
    """(hash of k words, template, position); a template under k words has none."""
    out = []
    for t, (_, text) in enumerate(templates):
        words = words_of(text)
        grams = rolling(words, k)[: max(0, len(words) - k + 1)].view(np.int64)
        out += [(int(g), t, p) for p, g in enumerate(grams)]
    return out


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | DataFrame | None = None, k: int = K, slack: int = SLACK, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Every verified notice: id, license, template, start_word, end_word (exclusive), votes, similarity.

    templates are pairs of a license and a text, or a table of them (whole
    licenses, say): see read_templates().

    Diagonals at most slack apart merge. The span is that of the votes, widened
    by the template's words before the first and after the last of them, and
    stands if its similarity to the template is min_similarity or more. Of claims
    on overlapping words the most similar stands, then the longest, then the
    first template's. Null and
    empty texts have no notice; repeated rows (same id and text) are scanned as
    one; equal texts under two ids each have theirs. Null ids stay null, an empty
    table gives no row, texts are read whole. Other columns are not read,
    whatever their names.
    """
    templates = TEMPLATES if templates is None else read_templates(templates) if isinstance(templates, DataFrame) else templates
    spark: SparkSession = docs.sparkSession
    inner = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text <> ''").withColumn("hash", F.xxhash64("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", STEP_BYTES):
            buf, offs = utf8(piece.column(1))
            buf = fold(buf)
            starts, ends, heads = spans(buf, offs, WORD_BYTE)
            every = rolling(hashes(buf, starts, ends), k).view(np.int64)
            owner = np.repeat(np.arange(piece.num_rows), np.diff(heads))
            at = np.arange(len(every)) - heads[owner]
            whole = np.flatnonzero(at + k <= np.diff(heads)[owner])
            take = pa.array(owner[whole])
            for a in range(0, len(whole), 1 << 18):
                rows = slice(a, a + (1 << 18))
                part = take[rows]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(part), piece.column(2).take(part), pa.array(at[whole[rows]].astype(np.int32)), pa.array(every[whole[rows]])], names=["id", "hash", "at", "gram"])

    lookup = spark.createDataFrame(postings(templates, k) or [(0, -1, 0)], "gram bigint, template int, place int")
    if lookup.count() * 16 <= 1 << 20:
        lookup = F.broadcast(lookup)
    votes = inner.mapInArrow(grams, "id bigint, hash bigint, at int, gram bigint").join(lookup, "gram").where("template >= 0")
    # repeated rows vote at the same places
    diagonals = votes.withColumn("diagonal", F.col("at") - F.col("place")).groupBy("id", "hash", "template", "diagonal").agg(F.count_distinct("at").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("place").alias("from_place"), F.max("place").alias("to_place"))
    line = Window.partitionBy("id", "hash", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > slack).cast("int"), F.lit(0))
    merged = diagonals.withColumn("apart", apart).withColumn("strand", F.sum("apart").over(line)).groupBy("id", "hash", "template", "strand")
    found = cut(merged.agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("from_place").alias("a"), F.max("to_place").alias("b")))
    claims = cut(found.groupBy("id", "hash").agg(F.collect_list(F.struct("template", "votes", "first", "last", "a", "b")).alias("claims")).select(F.col("id").alias("q_id"), F.col("hash").alias("q_hash"), "claims"))
    patterns = [words_of(text) for _, text in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", STEP_BYTES):
            buf, offs = utf8(piece.column(1))
            buf = fold(buf)
            starts, ends, heads = spans(buf, offs, WORD_BYTE)
            words = hashes(buf, starts, ends)
            out: list[tuple] = []
            for i, claim in enumerate(piece.column(2).to_pylist()):
                own = words[heads[i] : heads[i + 1]]
                real = []
                for c in claim:
                    goal = patterns[c["template"]]
                    a = max(0, c["first"] - c["a"])
                    b = min(len(own), c["last"] + k + len(goal) - k - c["b"])
                    s = similarity(goal, own[a:b])
                    if s >= min_similarity:
                        real.append((-s, a - b, c["template"], a, b, c["votes"]))
                taken: list[tuple[int, int]] = []
                for s, _, t, a, b, v in sorted(real):
                    if all(b <= x or y <= a for x, y in taken):
                        taken.append((a, b))
                        out.append((i, t, a, b, v, -s))
            if out:
                row, template, a, b, votes_, s = zip(*out)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array([templates[t][0] for t in template]), pa.array(template, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(votes_, pa.int64()), pa.array(s)], names=["id", "license", "template", "start_word", "end_word", "votes", "similarity"])

    # the texts of the claims alone come back
    asked = inner.join(sized(claims, 400), F.col("id").eqNullSafe(F.col("q_id")) & (F.col("hash") == F.col("q_hash"))).dropDuplicates(["id", "hash"]).select("id", "text", "claims")
    out = asked.mapInArrow(verify, "id bigint, license string, template int, start_word bigint, end_word bigint, votes bigint, similarity double")
    return out.withColumnRenamed("id", id_col)
