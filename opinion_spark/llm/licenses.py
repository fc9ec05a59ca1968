"""License scan by MinHash bands over overlapping text windows, with built-in functions only.

Templates are partitioned by the size of their shingle sets. For a partition of sizes up to ``u`` a document is read as
windows of ``2 u`` shingles, ``u`` apart, so a license text lies whole in one window and window and template differ in size
by a bounded factor. Each window gets as many MinHash bands (of one value each) as make a window that holds the required
share of a template's shingles collide in some band with a chance of at least ``1 - MISS``. The template of a band is
retrieved, and the share of its shingles that the whole document contains is then taken exactly.

All of it happens inside a document's row, against template arrays that are part of the plan (bounded by ``MAX_TEMPLATES``):
no shuffle, no join. Windows and documents without any template's shingle cannot collide in any band and are left out
before hashing, which drops no match.

Words are runs of letters and digits in lower case. A NULL or blank text, or one below five words, has no shingle and no match.
Repeated rows are reported each; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions.vector import let

#: Least share of a template's shingles, in hundredths.
PERCENT = 75
MISS = 1e-3
MAX_TEMPLATES = 500

# Fixed texts: short notices by which works state their license.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at"
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
}


def shingles_of(text: Column) -> Column:
    """Hashes of the five-word runs, in order."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")

    def hashed(w: Column) -> Column:
        return F.when(
            F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        ).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashed)


def signature(window: Column, bands: int) -> Column:
    """One least hash per band."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(bands)), lambda k: F.array_min(F.transform(window, lambda s: F.xxhash64(s, k)))
    )


def bands_for(lower: int, upper: int) -> int:
    """Bands after which a window of twice ``upper`` that holds PERCENT of ``lower`` shingles was missed with a chance below MISS."""
    shared = math.ceil(PERCENT * lower / 100)
    similarity = shared / (lower + 2 * upper - shared)
    return math.ceil(math.log(MISS) / math.log1p(-similarity))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _partitions(spark: SparkSession, templates: dict[str, str]) -> list[tuple[int, int, list[dict]]]:
    """(upper size, bands, templates with their shingles and signatures); templates are few and computed by the same functions."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates: scan with parts of them")
    rows = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", F.array_distinct(shingles_of(F.col("text"))).alias("shingles"))
    listed = [r.asDict() for r in rows.collect() if r["shingles"]]
    out, upper = [], 1
    while upper // 2 < max((len(r["shingles"]) for r in listed), default=0):
        lower = upper // 2 + 1
        names = [r["name"] for r in listed if lower <= len(r["shingles"]) <= upper]
        if names:
            bands = bands_for(lower, upper)
            signed = rows.where(F.col("name").isin(names)).select("name", "shingles", signature(F.col("shingles"), bands).alias("signature"))
            out.append((upper, bands, [r.asDict() for r in signed.orderBy("name").collect()]))
        upper *= 2
    return out


def _retrieved(shingles: Column, upper: int, bands: int, templates: list[dict]) -> Column:
    """Verified templates of one partition as structs (license, n_template, n_shared)."""
    listed = F.array(
        *[F.struct(F.lit(t["name"]).alias("license"), _longs(t["shingles"]).alias("shingles"), _longs(t["signature"]).alias("signature")) for t in templates]
    )
    known = _longs(sorted({s for t in templates for s in t["shingles"]}))
    windows = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(shingles), F.lit(upper)), lambda i: F.slice(shingles, i, 2 * upper)), lambda w: F.arrays_overlap(w, known)
    )

    def matched(signatures: Column) -> Column:
        def collides(t: Column) -> Column:
            return F.exists(signatures, lambda g: F.exists(F.zip_with(g, t["signature"], lambda a, b: a == b), lambda same: same))

        def exact(t: Column) -> Column:
            return F.struct(
                t["license"].alias("license"),
                F.size(t["shingles"]).cast("long").alias("n_template"),
                F.size(F.array_intersect(t["shingles"], shingles)).cast("long").alias("n_shared"),
            )

        return F.transform(F.filter(listed, collides), exact)

    return F.filter(
        let(F.transform(windows, lambda w: signature(w, bands)), matched), lambda m: 100 * m["n_shared"] >= PERCENT * m["n_template"]
    )


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """A row per document and license it holds: ``doc_id``, ``license``, ``n_template``, ``n_shared``."""
    partitions = _partitions(docs.sparkSession, TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(doc_id).alias("doc_id"), shingles_of(F.col(text)).alias("shingles"))
    known = sorted({s for _, _, ts in partitions for t in ts for s in t["shingles"]})
    if not known:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, n_template long, n_shared long")
    with_any = rows.where(F.arrays_overlap("shingles", _longs(known)))
    found = F.concat(*[_retrieved(F.col("shingles"), u, b, ts) for u, b, ts in partitions])
    return with_any.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
