"""License scans: MinHash bands over overlapping windows retrieve templates, shingles verify them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, whole_text

#: Words of a shingle, and the share of a template's shingles that a document must hold.
SHINGLE, CONTAINED = 5, 0.8
#: Shingles of a window, and shingles from one window's start to the next.
WINDOW, STRIDE = 8, 4
#: Bands of one MinHash row each. A template of up to 5 shingles lies in some window whole, with a Jaccard
#: similarity of 1 / WINDOW at least, and longer ones share more, so a copy is missed in one window with a chance
#: of (1 - 1 / WINDOW) ** BANDS = 9e-7 or less.
BANDS = 104
#: Templates go to the tasks in blocks of so many shingles, or of one longer template; each block is a pass over the documents.
BLOCK_SHINGLES = 5_000

# Wording of common license notices (id, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
]


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """A hash of each shingle in order; none for fewer words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.element_at(words, (i + k).cast("int")) for k in range(size))))


def shingle_texts(words: Column, size: int = SHINGLE) -> Column:
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " "))


def band_values(shingles: Column) -> Column:
    """(band, least hash of the window's shingles under the band's hash function)."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))).alias("least")))


def template_blocks(spark: SparkSession, templates: list[tuple[str, str]]) -> Iterator[tuple[int, DataFrame]]:
    """Words of a shingle, and the templates of that size (template, license, words), in blocks of about BLOCK_SHINGLES.

    A template of fewer words than SHINGLE is one shingle of all its words.
    """
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(templates)], "template int, license string, notice string")
    worded = rows.select("template", "license", words_of(F.col("notice")).alias("words")).where("size(words) > 0").collect()
    schema = "template int, license string, words array<string>"
    for size in range(1, SHINGLE + 1):
        block: list[tuple] = []
        filled = 0
        for t in (t for t in worded if min(SHINGLE, len(t["words"])) == size):
            if block and filled + len(t["words"]) > BLOCK_SHINGLES:
                yield size, spark.createDataFrame(block, schema)
                block, filled = [], 0
            block.append(tuple(t))
            filled += len(t["words"])
        if block:
            yield size, spark.createDataFrame(block, schema)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license template found: doc_id, license, template, containment, n_windows.

    Words are runs of letters and digits in lower case. Each text's shingles form overlapping windows; windows
    that hold no shingle of any template cannot match and need no signature, the others get one-row MinHash
    bands and retrieve the templates that have a window of the same band value. A template is found where the
    document holds at least the share `contained` of its distinct shingles, word for word.

    Templates (None: TEMPLATES; an empty list finds nothing) go to the tasks in blocks of bounded shingles, each a pass
    over the documents. One of fewer than SHINGLE words is found where its words follow one another; one without a
    word is never found. Null and empty texts hold nothing. Rows that repeat an id give one row per template, of the
    most contained; null ids are an id. Other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"doc_id {kind}, license string, template int, containment double, n_windows long")
    for size, block in template_blocks(docs.sparkSession, TEMPLATES if templates is None else templates):
        found = found.unionByName(_scan(docs, block, size, contained, id_col, text_col))
    return found


def _scan(docs: DataFrame, block: DataFrame, size: int, contained: float, id_col: str, text_col: str) -> DataFrame:
    table = block.select("template", "license", shingle_hashes(F.col("words"), size).alias("hashes"), shingle_texts(F.col("words"), size).alias("shingles"))
    known = [r["h"] for r in table.select(F.explode("hashes").alias("h")).distinct().collect()]

    worded = docs.select(F.col(id_col).alias("doc_id"), words_of(whole_text(text_col)).alias("words"))
    hashed = worded.select("doc_id", "words", shingle_hashes(F.col("words"), size).alias("hashes"))
    places = F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(F.greatest(F.lit(0), F.floor(i / STRIDE) * STRIDE - STRIDE), F.floor(i / STRIDE) * STRIDE))))
    # Exploding the outer way keeps the optimizer from computing the shingles again to filter by them.
    touched = hashed.withColumn("starts", F.when(F.exists("hashes", lambda h: h.isin(known)), F.array(starts))).select("doc_id", "words", "hashes", F.explode_outer("starts").alias("starts")).where("starts is not null")
    touched = stored(touched.withColumn("row", F.monotonically_increasing_id()))
    window = touched.select("row", "hashes", F.explode("starts").alias("start"))
    signed = window.select("row", "start", F.explode(band_values(F.slice("hashes", (F.col("start") + 1).cast("int"), WINDOW))).alias("b"))

    last = F.greatest(F.lit(0), F.size("hashes") - WINDOW)
    of_templates = table.select("template", "hashes", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    bands = stored(of_templates.select("template", F.explode(band_values(F.slice("hashes", F.col("start") + 1, WINDOW))).alias("b")).select("template", "b.*").distinct())
    candidates = signed.select("row", "start", "b.*").join(F.broadcast(bands), ["band", "least"]).groupBy("row", "template").agg(F.countDistinct("start").alias("n_windows"))

    full = candidates.join(touched.select("row", "doc_id", F.col("words").alias("own")), "row").join(F.broadcast(table.select("template", "license", "shingles")), "template")
    share = F.size(F.array_intersect(F.col("shingles"), shingle_texts(F.col("own"), size))) / F.size(F.array_distinct("shingles"))
    return full.select("doc_id", "license", "template", share.alias("containment"), "n_windows").where(F.col("containment") >= contained).groupBy("doc_id", "license", "template").agg(F.max("containment").alias("containment"), F.max("n_windows").alias("n_windows"))
