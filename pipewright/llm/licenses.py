"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

Texts and templates are lowered (A-Z), punctuation counts as space, and five
consecutive words make a shingle (a text of fewer words is one shingle),
hashed to 64 bits. A match may be longer than its template, as words put between cost only the
shingles they cut. A template belongs to the size class of the least power of two that is
not less than twice its words. For class c a text is cut to windows of 2c words,
one each c words, so every stretch of up to twice a template's words lies whole in one.

A window's signature is the least hash in each of `bins(...)` bins of the
hashes (one-permutation MinHash), each bin a band of one row. A template of s shingles
that a window holds to 0.8 shares ceil(0.8 s) of them, and each is the least of
its bin, in window and template alike, but for a chance of (hashes of either) / (2 bins) at most: 2c of the
window and the fifth of the template's that it may lack. So the chance that no band collides is about
that ratio to the power of the shared shingles (bins are taken as independent); `bins` makes it MISS or less
for every template of a class. Bands that collide retrieve (window, template) pairs, and exact
containment, shared shingles over the template's, must be 0.8 or more.

Bands are a few for each template, so documents are first asked whether they hold
any band value of a template at all; a window without one collides with none.

One row for each document and license found. Null and empty texts match
nothing. Rows that repeat a doc_id give one row together; a null doc_id is a
value like any other. Empty tables and no templates give no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm.common import ascii_lower

WORDS, CONTAINED, MISS = 5, 0.8, 1e-3
#: Opening words of public licenses and common notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\f\r"
_SPACES = " " * len(_PUNCTUATION)


def words(text: Column) -> Column:
    plain = F.translate(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _PUNCTUATION, _SPACES)
    return F.array_remove(F.split(plain, " "), "")


def shingles(w: Column) -> Column:
    """Hash of the five words from each word on; fewer words: of all."""
    at = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS)))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))), at))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def size_class(n_words: int) -> int:
    return max(8, 1 << (2 * n_words - 1).bit_length())


def bins(klass: int, least_shingles: int) -> int:
    """The fewest bins, a power of two, at which a window misses a template with a chance of MISS at most."""
    shared, n = math.ceil(CONTAINED * least_shingles), 16
    union = 2 * klass + (1 - CONTAINED) * klass  # a window's hashes, and the template's that it doesn't hold
    while (union / (2 * n)) ** shared > MISS:
        n *= 2
    return n


def _signature(hashes: Column, n: Column) -> Column:
    """(bin, least hash) of each bin that has any."""
    pairs = F.sort_array(F.transform(F.array_distinct(hashes), lambda h: F.struct(F.pmod(h, n).alias("bin"), h.alias("value"))))
    return _let(pairs, lambda p: F.filter(p, lambda e, k: ~F.coalesce(F.get(p, k - 1).bin == e.bin, F.lit(False))))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license, class, bins, its shingles and its signature; one row for each template."""
    sizes = {k: len(re.sub(f"[{re.escape(_PUNCTUATION)}]", " ", v).split()) for k, v in texts.items()}
    by: dict[int, int] = {}
    for n in sizes.values():
        if n:
            by[size_class(n)] = min(by.get(size_class(n), 1 << 30), max(1, n - WORDS + 1))
    rows = [(k, v, size_class(sizes[k]), bins(size_class(sizes[k]), by[size_class(sizes[k])])) for k, v in texts.items() if sizes[k]]
    table = spark.createDataFrame(rows, "license string, text string, class int, bins int")
    table = table.withColumn("own", F.array_distinct(shingles(words(F.col("text")))))
    return table.select("license", "class", "bins", "own", _signature(F.col("own"), F.col("bins")).alias("signature"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (the greatest), first_word (of the first such window), n_windows."""
    spark = docs.sparkSession
    made = templates(spark, TEMPLATES if texts is None else texts)
    kinds = made.collect()  # one row for each template: the caller's list
    values = sorted({s.value for t in kinds for s in t.signature})
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _let(words(F.col("text")), shingles).alias("hashes"))
    if not kinds:
        return own.where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("bigint").alias("first_word"), F.lit(0).cast("bigint").alias("n_windows"))
    held = own.where(F.arrays_overlap("hashes", F.array(*(F.lit(v) for v in values))))
    classes = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(n).alias("bins")) for c, n in sorted({(t["class"], t.bins) for t in kinds})))
    starts = lambda c: F.sequence(F.lit(0), F.greatest(F.size("hashes") - 1, F.lit(0)), c["class"])
    each = F.flatten(F.transform(classes, lambda c: F.transform(starts(c), lambda s: F.struct(c["class"].alias("class"), c["bins"].alias("bins"), s.alias("start")))))
    windows = held.select("doc_id", "hashes", F.explode(each).alias("w")).select("doc_id", "w.*", F.expr(f"slice(hashes, w.start + 1, 2 * w.class - {WORDS - 1})").alias("hashes"))
    windows = windows.withColumn("band", F.explode(_signature(F.col("hashes"), F.col("bins"))))
    bands = F.broadcast(made.select("license", "class", "own", F.explode("signature").alias("band")))  # a few for each template
    pairs = windows.join(bands, ["class", "band"])
    share = F.size(F.array_intersect("own", "hashes")) / F.size("own")
    matched = pairs.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    matched = matched.groupBy("doc_id", "license", "start").agg(F.max("containment").alias("containment"))
    return matched.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("bigint").alias("first_word"), F.count("*").alias("n_windows"))
