"""License scan: MinHash bands over overlapping text windows, then exact containment.

Words are runs of letters and digits in lower case, shingles five words; a notice of
fewer words is one shingle.  Of a text only shingles that some template has can count for a match, so windows are
described by these alone: text around a license adds nothing to a window's set,
and a window that holds 0.8 of a template's shingles resembles the template that
much, unless it also holds parts of others.  Windows overlap by half and come in
sizes that double, so for each template there is a size at which every place it
may stand at lies in one window whole.  A window and a template whose smallest
hash is equal in one of BANDS bands (of one row each) meet: at resemblance 0.3 that
happens with probability 1 - 0.7 ** 24 = 0.9998.  The pair is kept if the window
holds `threshold` or more of the template's shingles.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.native import let

WIDTH, THRESHOLD, BANDS = 5, 0.8, 24
#: Up to so many template shingles are part of the plan; more are joined.
IN_PLAN = 20_000

#: Short notices by which licenses are applied to a work.
NOTICES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "All rights reserved": ["All rights reserved."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingled(hashes: Column, width: int) -> Column:
    """Hashes of the shingles of width words by position, from the words' hashes; fewer words have none."""
    one = lambda a, i: F.xxhash64(*(F.get(a, i + j) for j in range(width)))
    none = F.expr("cast(array() as array<bigint>)")
    return let(hashes, lambda a: F.when(F.size(a) >= width, F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: one(a, i))).otherwise(none))


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of a text's shingles by position; shorter texts have none."""
    return _shingled(F.transform(words(text), lambda w: F.xxhash64(w)), width)


def templates(spark: SparkSession, notices: dict[str, list[str]] | None = None, width: int = WIDTH) -> DataFrame:
    """license, notice, n_words and shingles of each notice that has a word."""
    rows = [(k, i, t) for k, texts in (NOTICES if notices is None else notices).items() for i, t in enumerate(texts)]
    listed = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(i).alias("notice"), F.lit(t).alias("text")) for k, i, t in rows))
    table = spark.range(1).select(F.explode(listed).alias("t")).select("t.*") if rows else spark.range(0).select(F.lit("").alias("license"), F.lit(0).alias("notice"), F.lit("").alias("text"))
    n = F.size(words(F.col("text")))
    whole = reduce(lambda a, k: F.when(n == k, shingles(F.col("text"), k)).otherwise(a), range(1, width), shingles(F.col("text"), width))
    table = table.select("license", "notice", n.alias("n_words"), F.array_distinct(whole).alias("shingles"))
    return table.filter(F.size("shingles") > 0)


def _bands(hashes: Column) -> list[Column]:
    """The smallest of the hashes under each of BANDS orders."""
    rng = random.Random(5)
    flips = [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS)]
    return [F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(flip)))) for flip in flips]


def _hits(docs: DataFrame, widths: list[int], every: list[int], known: DataFrame) -> DataFrame:
    """doc_id and hits (i: first word, h) of the texts (doc_id, w: words' hashes) that share a shingle with a notice."""
    by_width = lambda w: F.flatten(F.array(*(F.transform(_shingled(w, n), lambda h, i: F.struct(i.alias("i"), h.alias("h"))) for n in widths)))
    found = let(F.col("w"), by_width)
    if len(every) <= IN_PLAN:
        hits = docs.select("doc_id", F.filter(found, lambda x: x["h"].isin(every)).alias("hits")) if every else docs.select("doc_id", found.alias("hits")).filter("false")
        return hits.filter(F.size("hits") > 0)
    of = known.select(F.explode("shingles").alias("known")).distinct()
    # rows that are equal in id and text are one document anyway
    rows = docs.select("doc_id", F.xxhash64("w").alias("text"), F.explode(found).alias("x")).join(of, F.col("x.h") == F.col("known"), "left_semi")
    return rows.groupBy("doc_id", "text").agg(F.collect_set("x").alias("hits")).select("doc_id", "hits")


def _windows(spots: Column) -> Column:
    """The windows (size, start, h) that sorted spots (size, at, i, h) lie in: start is the first hit's word, h the different hashes."""
    key = lambda i: F.struct(F.get(spots, i)["size"], F.get(spots, i)["at"])
    first = F.filter(F.sequence(F.lit(0), F.size(spots) - 1), lambda i: (i == 0) | (key(i) != key(i - 1)))

    def window(begins: Column, s: Column, j: Column) -> Column:
        end = F.coalesce(F.get(begins, j + 1), F.size(spots))
        # by place: a slice would copy all spots first
        hashes = F.transform(F.sequence(s, end - 1), lambda i: F.get(spots, i)["h"])
        return F.struct(F.get(spots, s)["size"].alias("size"), F.get(spots, s)["i"].alias("start"), F.array_distinct(hashes).alias("h"))

    return let(first, lambda begins: F.transform(begins, lambda s, j: window(begins, s, j)))


def scan(df: DataFrame, notices: dict[str, list[str]] | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """A row for each row of df and notice found in it: doc_id, license, notice, containment, start (first word), matches.

    containment is the largest share of the notice's shingles in one window,
    start the first word of the window's first shingle of any notice, for the
    earliest such window, and matches the number of windows.  Null and wordless texts have
    no rows; very long ones are read whole; rows of equal doc_id are one
    document to the result; no notices or an empty table give no rows.  Other
    columns are not read.
    """
    spark = df.sparkSession
    known = templates(spark, notices, width)
    # bounded: the notices are a parameter
    held = known.collect()
    every = sorted({s for r in held for s in r["shingles"]})
    sizes, size = [], 4 * width
    while held and (not sizes or sizes[-1] < 2 * max(r["n_words"] for r in held)):
        sizes.append(size)
        size *= 2
    sizes = sizes or [4 * width]
    widths = sorted({min(width, r["n_words"]) for r in held}) or [width]
    docs = df.select(F.col(doc_id).alias("doc_id"), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))
    docs = _hits(docs, widths, every, known)
    # a hit lies in two windows of each size: the one that begins at or before it, and the one half a size earlier
    place = lambda x, n: F.array(*(F.struct(F.lit(n).alias("size"), (F.floor(x["i"] / (n // 2)) - k).cast("int").alias("at"), x["i"].alias("i"), x["h"].alias("h")) for k in (0, 1)))
    spots = F.flatten(F.transform("hits", lambda x: F.flatten(F.array(*(place(x, n) for n in sizes)))))
    windows = docs.select("doc_id", F.explode(let(F.sort_array(spots), _windows)).alias("w")).select("doc_id", "w.size", F.struct("w.start", "w.h").alias("set"))
    banded = windows.select("doc_id", "size", "set", F.posexplode(F.array(*_bands(F.col("set.h")))).alias("band", "low"))
    of = known.select("license", "notice", "n_words", F.col("shingles").alias("t"), F.posexplode(F.array(*_bands(F.col("shingles")))).alias("t_band", "t_low"))
    fits = (F.col("size") >= 2 * F.col("n_words")) | (F.col("size") == (sizes or [0])[-1])
    met = banded.join(F.broadcast(of), (F.col("band") == F.col("t_band")) & (F.col("low") == F.col("t_low"))).filter(fits)
    share = F.size(F.array_intersect("set.h", "t")) / F.size("t")
    # a window meets a notice in up to BANDS bands; the first of them counts
    found = met.select("doc_id", "license", "notice", "size", F.col("set.start").alias("start"), share.alias("containment"), "set").filter(F.col("containment") >= threshold)
    found = found.select("doc_id", "license", "notice", "containment", F.struct("size", "start").alias("window"))
    best = F.max(F.struct("containment", (-F.col("window.start")).alias("back")))
    return found.groupBy("doc_id", "license", "notice").agg(best.alias("best"), F.count_distinct("window").alias("matches")).select("doc_id", "license", "notice", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("start"), "matches")
