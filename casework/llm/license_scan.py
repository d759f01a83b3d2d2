"""License texts by minima of window shingles.

A text's words (letters and digits, lower case) give five-word shingles. For each template
length L the text is cut into windows of 2L words, L apart, so any passage of L words lies whole in one
window. ``BANDS`` hashes each give a window's least value; a band is one minimum, and a window retrieves
the templates that share one. A window with the template in it to three
quarters has a similarity of at least one sixth, so 64 bands miss it with a
probability below 1 in 100,000; :func:`least_collision` states it for each template. Retrieved
templates match if the window holds at least 75 percent of their distinct shingles.

A window without any shingle of a template cannot share a minimum with one, so
minima are taken of the other windows only. All of this is column expressions
on one row; the templates' shingles and minima are literals of fixed size in them.

A null text is empty; texts without words or of fewer than five have no matches.
Rows that repeat are scanned each and an empty table gives an empty result. Only the id
and the text are read, so names cannot clash; a null id is carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import id_and_text

WIDTH = 5
BANDS = 64
PERCENT = 75

#: Fixed texts of public licenses and notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                         "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                  "conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                  "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
                 "that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                 "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
                 "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(found: Column) -> Column:
    """64-bit hashes of the runs of five words, in order; none below five."""
    at = lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(WIDTH)])
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(F.size(found) < WIDTH, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(found) - WIDTH), at))


def minima(hashes: Column) -> Column:
    """The least value of each of ``BANDS`` hashes of the shingles."""
    number = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(number, lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def least_collision(length: int) -> float:
    """The probability that a window with a template of ``length`` words in it to
    ``PERCENT`` shares a minimum with it: 1 - (1 - s) ** BANDS."""
    own = length - WIDTH + 1
    common = math.ceil(own * PERCENT / 100)
    window = 2 * length - WIDTH + 1
    return 1 - (1 - common / (own + window - common)) ** BANDS


def template_rows(docs: DataFrame, templates: dict[str, str]) -> list:
    """license, words and distinct shingles of each template (a fixed list)."""
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(templates.items())]))
    one = docs.sparkSession.range(1).select(table.alias("t")).select("t.*").withColumn("words", words(F.col("text")))
    rows = one.select("license", F.size("words").alias("length"), F.array_distinct(shingles(F.col("words"))).alias("shingles")).collect()
    short = [r.license for r in rows if not r.shingles]
    if short:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    return rows


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_licenses, licenses (names, comma-joined) and the matches
    (license, window's first word, percent of its shingles) of every row."""
    known = template_rows(docs, templates)
    all_shingles = sorted({h for r in known for h in r.shingles})
    lengths = sorted({r.length for r in known})

    rows = id_and_text(docs, id_col, text_col).select("doc_id", words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", shingles(F.col("words")).alias("hashes"))
    # Places of template shingles; most texts have none and are done.
    hits = F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(all_shingles), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", hits.alias("hits"), "hashes")

    def windows(length: int) -> Column:
        # A shingle at i lies in windows that begin at most 2L - 5 words before.
        last = lambda i: F.floor(i / length).cast("int")
        first = lambda i: F.greatest(F.lit(0), F.ceil((i - (2 * length - WIDTH)) / length).cast("int"))
        begins = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(first(i), last(i)))))
        part = lambda j: F.slice("hashes", j * length + 1, F.lit(2 * length - WIDTH + 1))
        return F.transform(begins, lambda j: F.struct(F.lit(length).alias("length"), (j * length).alias("begin"), part(j).alias("hashes"),
                                                      minima(part(j)).alias("least")))

    # The templates' own minima: ``BANDS`` numbers each.
    longs = lambda values: F.lit(values).cast("array<bigint>")
    sets = F.array(*[F.struct(F.lit(r.license).alias("license"), longs(r.shingles).alias("shingles")) for r in known])
    one = docs.sparkSession.range(1).select(F.explode(sets).alias("t")).select("t.license", minima(F.col("t.shingles")).alias("least"))
    own = {r.license: r.least for r in one.collect()}

    def matches(window: Column) -> Column:
        found = []
        for r in known:
            retrieved = F.exists(F.zip_with(window["least"], longs(own[r.license]), lambda a, b: a == b), lambda x: x)
            common = F.size(F.array_intersect(window["hashes"], longs(r.shingles)))
            match = F.struct(F.lit(r.license).alias("license"), window["begin"].alias("begin"), (100 * common / len(r.shingles)).alias("percent"))
            found.append(F.when((window["length"] == r.length) & retrieved & (100 * common >= PERCENT * len(r.shingles)), match))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    none = F.expr("cast(array() as array<struct<license: string, begin: int, percent: double>>)")
    every = F.flatten(F.transform(F.concat(*[windows(n) for n in lengths]), matches))
    out = rows.select("doc_id", F.when(F.size("hits") == 0, none).otherwise(every).alias("matches"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return out.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), "matches")
