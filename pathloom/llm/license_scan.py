"""License notices found by MinHash bands over overlapping windows of words (operator 1).

Templates of LONG shingles or more are looked for by windows of WINDOW shingles of five words, twenty words in all, that
start at each STEP-th word of a text and at each word of a template. A window's signature is the least and the greatest of
its shingles in ORDERS orders, an order being that of the shingle hashes' bits from a bit of its own on, and each of these
is a band: as a row stands for five words in a row, bands of one row meet by chance rarely enough, and more rows would only
miss more. Where a text holds 0.8 of a template's shingles together, one of its windows has a Jaccard similarity of 0.6 or
more with the template's window at the same words (2/3 if the template is long), so they share a band with a chance of
1 - 0.4^10 = 0.9999 at least. Shorter templates are looked for by windows of one shingle, whose one band is the shingle, so
they are found for certain.

Bands are looked up in a bitmap of bounded size first, so that hardly any window is written that matches nothing, and then
joined with the templates' bands. Candidates are verified on whole sets: a template matches where at least `least` of its
distinct shingles lie in the words around a window. Everything is a DataFrame function.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import spread_join, stored

SHINGLE, WINDOW, STEP, ORDERS = 5, 16, 8, 5
#: Shingles of a template from which a text that holds it has a whole window inside.
LONG = WINDOW + STEP - 1
#: Bits by which the orders are apart.
TURN = 5
#: Bits of the bitmap for each band, the base-2 logarithm of its largest size, and where a band's places in it begin.
BAND_BITS, MAP_BITS, PLACES = 256, 22, (16, 23, 30)
#: Bands of templates up to which they are sent to every task; 16 bytes each.
BROADCAST_BANDS = 1_000_000

#: Wordings of common public licences and of the lines that refer to them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lowered runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def shingles(text: Column) -> Column:
    """Hashes of the runs of SHINGLE words, by the first word's place."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))

    return _let(words(text), of)


def _bands(x: Column) -> Column:
    """array<long>: the least and the greatest of an array in each order."""

    def both(k: int) -> Column:
        return _let(F.transform(x, lambda v: F.shiftleft(v, k * TURN)) if k else x, lambda t: F.array(F.array_min(t), F.array_max(t)))

    return F.flatten(F.array(*(both(k) for k in range(ORDERS))))


def _run(sh: Column, i: Column, n: int) -> Column:
    """The n shingles from i on, or what is left of them; nulls are skipped by all that follows."""
    return F.array(*(F.get(sh, i + k) for k in range(n)))


def windows(sh: Column) -> Column:
    """array<array<long>>: the bands of the window at each STEP-th shingle, each from the bands of WINDOW / STEP blocks."""
    starts = F.sequence(F.lit(0), F.size(sh) - 1, F.lit(STEP))

    def joined(blocks: Column, x: Column, i: Column) -> Column:
        more = [F.get(blocks, i + k) for k in range(1, WINDOW // STEP)]
        of = lambda f, k: f(F.get(x, F.lit(k)), *(F.get(m, F.lit(k)) for m in more))
        return F.array(*(of(F.greatest if k % 2 else F.least, k) for k in range(2 * ORDERS)))

    return _let(F.transform(starts, lambda i: _bands(_run(sh, i, STEP))), lambda blocks: F.transform(blocks, lambda x, i: joined(blocks, x, i)))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license, sh (shingles) of each template; of a size that the parameter fixes."""
    held = json.dumps([{"license": k, "text": v} for k, v in (texts or TEMPLATES).items()])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(held), "array<struct<license:string,text:string>>")).alias("t")).select("t.*")
    return rows.select("license", shingles(F.col("text")).alias("sh")).where(F.size("sh") > 0)


def template_bands(t: DataFrame) -> DataFrame:
    """license, band of the templates' windows."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("sh") - WINDOW, F.lit(0)))
    long = F.flatten(F.transform(starts, lambda i: _bands(_run(F.col("sh"), i, WINDOW))))
    return t.select("license", F.explode(F.when(F.size("sh") >= LONG, long).otherwise(F.col("sh"))).alias("band")).distinct()


def _place(band: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(band, at).bitwiseAND(F.lit((1 << bits) - 1))


def scanned(docs: DataFrame, least: float = 0.8, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per document and template that it holds: doc_id, license, containment, first_word, last_word.

    containment is the largest share of the template's distinct five-word shingles that lie together around a window, at
    least `least`, ties included; first_word and last_word are the places of the first and the last window that found it.
    Words are lowered runs of ASCII letters and digits, and whole texts are scanned, however long. Null texts, and texts of
    under five words, hold nothing; rows that repeat a doc_id count as one document, null ids too; other columns are
    ignored; an empty table gives an empty one. Templates of under five words match nothing.
    """
    t = stored(templates(docs.sparkSession, texts), "templates")
    wanted = stored(template_bands(t), "bands")
    n = wanted.count()
    bits = min(MAP_BITS, max(12, (BAND_BITS * max(n, 1)).bit_length()))
    places = wanted.select(F.explode(F.array(*(_place(F.col("band"), at, bits) for at in PLACES))).alias("p")).distinct()
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    held = {r["w"]: r["v"] for r in words.collect()}  # at most 2^(MAP_BITS - 6) numbers
    bitmap = F.from_json(F.lit(json.dumps([held.get(w, 0) for w in range(1 << (bits - 6))])), "array<bigint>")
    sizes = t.agg(F.max(F.size("sh")).alias("most"), F.count_if(F.size("sh") >= LONG).alias("long"), F.count_if(F.size("sh") < LONG).alias("short")).first()
    reach = sizes["most"] or 0

    def known(band: Column) -> Column:
        """Whether a template may have the band: for one in 10^5 others, too."""

        def held(at: int) -> Column:
            p = _place(band, at, bits)
            return F.getbit(F.get(bitmap, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1

        return held(PLACES[0]) & held(PLACES[1]) & held(PLACES[2])

    def hits(sh: Column) -> Column:
        """Windows with a band that a template may have."""

        def told(bands: Column, i: Column) -> Column:
            return _let(F.filter(bands, known), lambda b: F.when(F.size(b) > 0, F.struct(i.cast("int").alias("i"), b.alias("bands"))))

        none = F.array().cast("array<struct<i:int,bands:array<bigint>>>")
        each = F.transform(sh, lambda x, i: F.when(known(x), F.struct(i.alias("i"), F.array(x).alias("bands")))) if sizes["short"] else none
        wide = F.transform(windows(sh), lambda b, i: told(b, i * STEP)) if sizes["long"] else none
        return F.when(F.size(sh) > 0, F.filter(F.concat(each, wide), lambda x: x.isNotNull()))

    found = _let(shingles(F.col("text")), lambda sh: F.struct(sh.alias("sh"), hits(sh).alias("hits")))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("x")).where(F.size("x.hits") > 0)
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "x.*"), "hits")  # of few documents, read twice
    seen = rows.select("row", F.explode("hits").alias("h")).select("row", "h.i", F.explode("h.bands").alias("band"))
    if n <= BROADCAST_BANDS:
        seen, t = seen.join(F.broadcast(wanted), "band"), F.broadcast(t)  # a template has no more shingles than bands
    else:
        seen = stored(seen, "windows")
        seen = spread_join(seen, wanted, ["band"], seen.groupBy("band").agg(F.count(F.lit(1)).alias("n")), seen.count())
    places = seen.groupBy("row", "license").agg(F.sort_array(F.collect_set("i")).alias("places"))
    pairs = places.join(rows.select("row", "doc_id", F.col("sh").alias("own")), "row").join(t, "license")

    def share(i: Column) -> Column:
        at = F.sequence(F.greatest(i - reach, F.lit(0)), F.least(i + reach + WINDOW, F.size("own")) - 1)
        around = F.transform(at, lambda j: F.get(F.col("own"), j))
        return F.struct((F.size(F.array_intersect("wanted", around)) / F.size("wanted")).alias("share"), i.alias("i"))

    pairs = pairs.withColumn("wanted", F.array_distinct("sh"))
    told = pairs.select("doc_id", "license", F.filter(F.transform("places", share), lambda x: x["share"] >= least).alias("m")).where(F.size("m") > 0)
    out = told.groupBy("doc_id", "license").agg(F.max(F.array_max("m")["share"]).alias("containment"), F.min(F.get("m", F.lit(0))["i"]).alias("first_word"), F.max(F.element_at("m", -1)["i"]).alias("last_word"))
    return out.select("doc_id", "license", "containment", "first_word", "last_word")
