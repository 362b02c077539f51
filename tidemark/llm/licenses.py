"""License scans, native: MinHash bands over overlapping windows, then exact shingle containment.

Everything is a Spark expression. A text's 3-word shingles are hashed; 6 shingles make a block and two
neighbouring blocks a window, so that windows overlap by half. Each of 24 orders of the hashes (an XOR with a
constant reorders uniform hashes) gives a window its smallest one; each is a band of one row. Template
windows of 12 shingles are indexed at every offset, shorter templates whole. A window inside a copied
template equals one of the indexed windows in all 24 bands; for the shortest template, 3 shingles in a
window of 12, a band collides with probability 3/12, and all 24 fail with probability 0.75^24 = 0.1 %.
Retrieved templates match where the text holds at least 80 % of the template's distinct shingles.

A text that holds no shingle of any template can't match and skips the bands. No row meets another: there
is no shuffle. The templates are a fixed list, so that the literals sent with the plan are bounded (a few
thousand).

Cases: null, empty and short texts (fewer than three words) hold no license. Very long texts are read
whole. Each row is judged by itself: repeated rows, rows that share an id and rows without one give a row
each where they hold a license; an empty table gives no rows. Several licenses are listed in
alphabetical order. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SHINGLE = 3
BLOCK = 6
BANDS = 24
NUM, DEN = 4, 5

#: License notices: fixed values, each the usual wording.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: The orders' constants: bits of the golden ratio's multiples, which differ in their leading bits.
ORDERS = [((k + 1) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(BANDS)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """64-bit hashes of each run of three words, in order; empty for fewer words."""
    n = F.size(words) - (SHINGLE - 1)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(SHINGLE))))


def smallest(shingles: Column, constant: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(constant))))


def of_block(constant: int):
    return lambda block: smallest(block, constant)


def fenced(d: DataFrame, *columns) -> DataFrame:
    """``d.select(columns)`` that the optimizer neither merges with the next step nor pushes filters
    through, so that each expression is evaluated once a row: a generator of one row stands between."""
    return d.select(F.inline(F.array(F.struct(*columns))))


def band_key(smallest_hash: Column, order: int) -> Column:
    return F.xxhash64(smallest_hash, F.lit(order))


def template_rows(spark) -> DataFrame:
    """(template, license, shingles): a row per template."""
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    d = spark.createDataFrame(rows, "template int, license string, text string")
    return d.select("template", "license", F.array_distinct(shingles_of(words_of(F.col("text")))).alias("wanted"), shingles_of(words_of(F.col("text"))).alias("shingles"))


def template_keys(templates: DataFrame) -> DataFrame:
    """(order, key, template) of every template window in every band."""
    size = 2 * BLOCK
    last = F.greatest(F.size("shingles") - size, F.lit(0))
    w = templates.select("template", F.explode(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.slice("shingles", i, size))).alias("w"))
    keys = F.array(*(band_key(smallest(F.col("w"), c), k) for k, c in enumerate(ORDERS)))
    return w.select("template", F.posexplode(keys).alias("order", "key")).distinct()


def matches_by_row(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, matches): of each row that holds any template the structs (license, template, contained)."""
    spark = docs.sparkSession
    templates = template_rows(spark).cache()
    known = [(r.order, r.key, r.template) for r in template_keys(templates).collect()]
    wanted = {r.template: (r.license, r.wanted) for r in templates.collect()}
    templates.unpersist()
    by_order = [sorted({k for o, k, _ in known if o == order}) for order in range(BANDS)]
    d = fenced(docs, F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    d = fenced(d, "doc_id", shingles_of(F.col("words")).alias("shingles"))
    # a match holds most of a template's shingles: texts with none of any template need no bands
    some = sorted({x for _, need in wanted.values() for x in need})
    d = d.filter(F.exists("shingles", lambda x: x.isin(some)))
    starts = F.sequence(F.lit(0), F.ceil(F.size("shingles") / F.lit(BLOCK)).cast("int") - 1)
    d = fenced(d, "doc_id", "shingles", F.transform(starts, lambda b: F.slice("shingles", b * BLOCK + 1, BLOCK)).alias("blocks"))
    d = fenced(d, "doc_id", "shingles", *(F.transform("blocks", of_block(c)).alias(f"m{k}") for k, c in enumerate(ORDERS)))

    def hits(k: int) -> Column:
        m = F.col(f"m{k}")
        window = F.transform(m, lambda x, i: band_key(F.least(x, F.get(m, i + 1)), k))
        return F.filter(window, lambda key: key.isin(by_order[k]))

    d = fenced(d, "doc_id", "shingles", F.array_distinct(F.concat(*(hits(k) for k in range(BANDS)))).alias("hits")).filter(F.size("hits") > 0)
    by_template = {t: sorted({k for _, k, x in known if x == t}) for t in wanted}
    literal = lambda values: F.array(*(F.lit(v) for v in values))
    has = lambda some: lambda h: h.isin(some)
    found = [
        F.when(
            F.exists("hits", has(by_template[t])),
            F.struct(F.lit(name).alias("license"), F.lit(t).alias("template"), (F.size(F.array_intersect(literal(need), F.col("shingles"))) / F.lit(len(need))).alias("contained")),
        )
        for t, (name, need) in sorted(wanted.items())
    ]
    d = fenced(d, "doc_id", F.array(*found).alias("found"))
    return d.select("doc_id", F.filter("found", lambda m: m["contained"] * DEN >= NUM).alias("matches")).filter(F.size("matches") > 0)


def license_matches(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, license, template, contained): templates that a text holds; ``contained`` is their share."""
    return matches_by_row(docs, id_col, text_col).select("doc_id", F.inline("matches"))


def license_lists(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, licenses) of each row that holds any: their distinct names, joined by commas."""
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return matches_by_row(docs, id_col, text_col).select("doc_id", F.array_join(names, ",").alias("licenses"))


def op9_license_scan(spark, sf_dir):
    return license_lists(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same by exact containment over all pairs of a document and a template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(TEMPLATES))
    split = lambda t: rf"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w}) - {SHINGLE - 2}), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"
    return (
        f"WITH t AS (SELECT template, license, {split('text')} AS w FROM (VALUES {values}) v(template, license, text)), "
        f"tg AS (SELECT template, license, unnest({grams('w')}) AS g, len({grams('w')}) AS n FROM t), "
        f"d AS (SELECT doc_id, {split('text')} AS w FROM documents), dg AS (SELECT DISTINCT doc_id, unnest({grams('w')}) AS g FROM d), "
        f"m AS (SELECT doc_id, template, license FROM dg JOIN tg USING (g) GROUP BY doc_id, template, license, n HAVING {DEN} * count(*) >= {NUM} * n) "
        "SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY doc_id"
    )
