"""License scans by MinHash over overlapping text windows, in DataFrame functions only.

A template of m word shingles is looked for in windows of w shingles that start
every w/4, with m + w/4 <= w, so some window holds any full occurrence. A window
and a template have one minimum for each of ``HASHES`` independent hash functions
(each hashes its number and the shingle's hash); a band is one of them, and one equal
band retrieves the template. At a Jaccard similarity s a window is retrieved with
probability 1 - (1 - s)^HASHES. Window sizes grow by about a half, so a window with
a whole template has s >= 0.25 (the shortest templates) and mostly 0.4 or more:
0.9999 or more with 32 of them, and four windows hold an occurrence as a rule. At a
containment of 0.8 it is above 0.998 a window. What is retrieved is verified exactly:
of the stretches of as many places as the template has shingles, each starting at one
of these, the best must hold a share of them of ``CONTAINMENT``.

A band can only be equal if the window holds the very shingle whose hash is the
template's minimum. So texts, and within them places, without any of these
shingles are passed over before windows are formed; no match is lost by that.

Templates are a bounded list (their shingles are literals of the plan), at most
``MOST_TEMPLATES``; more of them take further scans. Nothing is shuffled.

Defined results: null and empty texts and texts of fewer than five words match
nothing. Repeated rows stay, each with its own matches. A null doc_id is kept.
Templates of fewer than five words are refused. An empty table gives an empty
result. Other columns are not looked at. Of several occurrences of one template
in one document the best one counts, of equal ones the first.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.functions.columns import computed_once

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
HASHES = 32
MOST_TEMPLATES = 64

# fixed values: wording of public license notices
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0-terms": "you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
    "MPL was not distributed with this file, You can obtain one at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation",
    "as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
}


def words(text):
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens):
    """Hashes of all runs of five words."""
    last = F.size(tokens) - SHINGLE_WORDS
    one = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE_WORDS)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def window_size(m):
    """The smallest window, a multiple of four and growing by about a half, with room for m shingles at any start."""
    w = 4
    while w - w // 4 + 1 < m:
        w = -(-w * 3 // 8) * 4
    return w


def prepared(spark, templates: dict) -> list:
    """(name, shingles, minimum and its shingle by hash function, window) of every template."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = computed_once(rows.select("name", words(F.col("text")).alias("w")), {"s": shingles(F.col("w"))})
    least = [
        F.array_min(F.transform("s", lambda x: F.struct(F.xxhash64(F.lit(k), x).alias("minimum"), x.alias("shingle"))))
        for k in range(HASHES)
    ]
    ready = []
    for name, found, minima in rows.select("name", F.array_distinct("s"), F.array(*least)).collect():
        if not found:
            raise ValueError(f"template {name} has fewer than {SHINGLE_WORDS} words")
        ready.append((name, found, minima, window_size(len(found))))
    return ready


def _longs(values):
    return F.array(*[F.lit(v) for v in values])


def _literal(template):
    name, found, minima, window = template
    return F.struct(
        F.lit(name).alias("name"),
        _longs(found).alias("found"),
        _longs(m["minimum"] for m in minima).alias("minima"),
        F.lit(window).alias("window"),
    )


def _windows(template):
    """Distinct starts of the template's windows that hold an anchor place, ascending."""
    step = (template["window"] / 4).cast("int")
    around = F.transform(
        "anchors",
        lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(3)), lambda k: F.greatest(F.lit(0), ((p / step).cast("int") - k) * step)
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(around)))


def _checked(template):
    """(containment, start) of the template's best stretch in a retrieved window; the struct orders better and earlier ones up."""
    numbers = F.array(*[F.lit(k) for k in range(HASHES)])
    pairs = F.arrays_zip(numbers.alias("number"), template["minima"].alias("minimum"))
    size = F.size(template["found"])

    def stretch(start):
        share = F.size(F.array_intersect(F.slice("shingles", start + 1, size), template["found"])) / size
        return F.struct(share.alias("containment"), (-start).alias("back"))

    def one(start):
        part = F.slice("shingles", start + 1, template["window"])
        hit = F.exists(
            pairs, lambda z: F.array_min(F.transform(part, lambda x: F.xxhash64(z["number"], x))) == z["minimum"]
        )
        within = F.sequence(start, start + F.size(part) - 1)
        begins = F.filter(within, lambda i: F.array_contains(template["found"], F.get("shingles", i)))
        return F.when(hit, F.array_max(F.transform(begins, stretch)))

    return F.array_max(F.transform(_windows(template), one))


def scan(docs: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word) of every match in ``docs`` (doc_id, text)."""
    names = sorted(templates)
    found = None
    for at in range(0, max(1, len(names)), MOST_TEMPLATES):
        part = _scan(docs, prepared(docs.sparkSession, {n: templates[n] for n in names[at : at + MOST_TEMPLATES]}))
        found = part if found is None else found.unionByName(part)
    return found


def _scan(docs, ready):
    # by template the shingles that are its minima: the only ones that can make a band equal
    minima = sorted({m["shingle"] for _, _, least, _ in ready for m in least})
    cut = computed_once(docs.select("doc_id", "text"), {"w": words(F.col("text"))}).select("doc_id", "w")
    hashed = computed_once(cut, {"shingles": shingles(F.col("w"))}).select("doc_id", "shingles")
    telling = lambda x: x.isin(*minima)
    some = hashed.where(F.exists("shingles", telling))
    places = F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: telling(F.get("shingles", i)))
    placed = computed_once(some, {"anchors": places})
    checked = F.transform(
        F.array(*map(_literal, ready)), lambda t: F.struct(t["name"].alias("license"), _checked(t).alias("best"))
    )
    matches = placed.select("doc_id", F.inline(checked))
    return matches.where(F.col("best.containment") >= CONTAINMENT).select(
        "doc_id",
        "license",
        F.col("best.containment").alias("containment"),
        (-F.col("best.back")).cast("long").alias("first_word"),
    )


def op2_minhash_license_scan(spark, sf_dir):
    """All of ``documents`` against the default templates: best containment by document and license."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "license", "containment")


def _sql():
    rows = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
    cut = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    return f"""
WITH template AS (
  SELECT license, {cut} AS w FROM (VALUES {rows}) AS t(license, text)
), wanted AS (
  SELECT DISTINCT license, list_slice(w, i, i + 4) AS g FROM template, unnest(range(1, len(w) - 3)) AS t(i)
), sizes AS (
  SELECT license, count(*) AS m FROM wanted GROUP BY license
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, {cut} AS w FROM documents
), place AS (
  SELECT rid, doc_id, i, list_slice(w, i, i + 4) AS g FROM doc, unnest(range(1, len(w) - 3)) AS t(i)
), met AS (
  SELECT rid, doc_id, license, i, g FROM place JOIN wanted USING (g)
), around AS (
  SELECT a.rid, a.doc_id, a.license, a.i, count(DISTINCT b.g) AS n
  FROM met AS a JOIN sizes USING (license)
  JOIN met AS b ON a.rid = b.rid AND a.license = b.license AND b.i BETWEEN a.i AND a.i + m - 1
  GROUP BY ALL
)
SELECT doc_id, license, max(n) / max(m) AS containment
FROM around JOIN sizes USING (license) GROUP BY rid, doc_id, license HAVING max(n) / max(m) >= 0.8
"""


OP2_SQL = _sql()
