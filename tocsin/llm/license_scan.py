"""Licence scan in DataFrame functions only: texts against templates by Dice coefficient over word bigrams.

A unit is a line of a document, and the whole text where it has several lines. A match with coefficient t needs
t / (2 - t) of the template's bigrams, so it holds one of the template's rarest bigrams; units without any of these
are dropped before they are compared, and size bounds prune the templates of the others.

A span is a run of words anywhere in a text: a notice that is wrapped or ends a line of prose, a licence's whole body
within a longer document. Of a text that holds enough of a template's bigrams, a running score that rises with each of
them and falls with each other bigram cuts out the spans, which are then judged by their own sets like units.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch

#: Fixed texts: notices as they stand in files, and the short licences' grants.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Licences whose whole text lies in the folder licenses, for spans.
BODIES = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
PERCENT = 80
#: A span is judged over as many words as its template has, if those are fewer: what a short notice lacks may be the name.
SHORT = 40
_OTHER = "[^\\p{L}\\p{N}]+"


def bodies() -> dict[str, tuple[str, ...]]:
    """The whole texts of BODIES."""
    return {name: (pkgutil.get_data("tocsin.llm", f"licenses/{name}.txt").decode(),) for name in BODIES}


def _words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order; a single word is paired with nothing."""
    words = _words_of(text)
    return list(dict.fromkeys([f"{a} {b}" for a, b in zip(words, words[1:])] or words))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), _OTHER, " "), " ", -1), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """The same bigrams as hashes of both words' hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    two = lambda h: F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i)))).otherwise(h)
    return F.transform(F.array(hashes), two)[0]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _table(spark: SparkSession, templates: dict[str, tuple[str, ...]], percent: int) -> DataFrame:
    """(license, variant, words, template, rare): each template's bigrams and its rarest ones as hashes."""
    known = [(name, k, len(_words_of(t)), bigrams_of(t)) for name, texts in sorted(templates.items()) for k, t in enumerate(texts)]
    spread: dict[str, int] = {}
    for b in chain.from_iterable(b for *_, b in known):
        spread[b] = spread.get(b, 0) + 1
    rows = []
    for name, k, n, own in known:
        needed = math.ceil(percent * len(own) / (200 - percent))
        rare = sorted(own, key=lambda b: (spread[b], -len(b), b))[: len(own) - needed + 1]
        rows.append((name, k, n, own, rare))
    hashed = lambda c: F.transform(c, lambda b: F.transform(F.array(F.split(b, " ")), lambda w: F.when(F.size(w) > 1, F.xxhash64(F.xxhash64(w[0]), F.xxhash64(F.get(w, F.lit(1))))).otherwise(F.xxhash64(w[0])))[0])
    table = spark.createDataFrame(rows, "license string, variant int, words int, bigrams array<string>, rare array<string>")
    return table.select("license", "variant", "words", hashed(F.col("bigrams")).alias("template"), hashed(F.col("rare")).alias("rare"))


def _rare(table: DataFrame) -> Column:
    """All rare bigrams of a table of templates, as one constant."""
    found = [str(r[0]) for r in table.select(F.explode("rare")).distinct().collect()]  # the templates bound their number
    return F.split(F.lit(",".join(found)), ",").cast("array<bigint>")


def _units(text: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """(row, doc_id, line_no, license, common, size, template_size) of each line and whole text."""
    rare = _rare(table)
    lines = F.transform(F.split(F.col("text"), "\n", -1), lambda line, k: F.struct((k + 1).alias("line_no"), line.alias("line")))
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.struct(F.lit(0).alias("line_no"), F.col("text").alias("line"))), lines)).otherwise(lines)
    units = text.select("row", "doc_id", F.explode(units).alias("unit"))
    units = units.select("row", "doc_id", "unit.line_no", F.array_distinct(_pairs(_words(F.col("unit.line")))).alias("own"))
    units = units.where((F.size("own") > 0) & F.arrays_overlap("own", rare))
    a, b = F.size("own"), F.size("template")
    fits = ((200 - percent) * a >= percent * b) & ((200 - percent) * b >= percent * a) & F.arrays_overlap("own", "rare")
    met = units.join(F.broadcast(table), fits)
    met = met.select("row", "doc_id", "line_no", "license", F.size(F.array_intersect("own", "template")).alias("common"), a.alias("size"), b.alias("template_size"))
    met = met.where(200 * F.col("common") >= percent * (F.col("size") + F.col("template_size")))
    dice = 2 * F.col("common") / (F.col("size") + F.col("template_size"))
    best = met.groupBy("row", "doc_id", "line_no").agg(F.min(F.struct((-dice).alias("d"), "license", "template_size", "common", "size")).alias("m"))
    return best.select("row", "doc_id", "line_no", "m.license", "m.common", "m.size", "m.template_size")


def _cut_out(places: Column, size: Column, words: Column, percent: int) -> Column:
    """Runs (lo, hi) of bigrams among which a template's own, at `places`, are dense enough to be worth judging.

    A match has 200 * common - percent * size >= percent * template size, so a template's bigram scores 200 - percent
    and any other one -percent. A run ends where its score falls to 0, or past the largest size that can match; it is
    cut at its best score within the template's length and at its best score of all.
    """
    up, reach = 200 - percent, words * (200 - percent) / percent
    run = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    ended = lambda s: F.when(2 * s["top"] >= percent * size, F.concat(s["out"], F.array(run(s["lo"], s["hi"]), run(s["lo"], s["near"])))).otherwise(s["out"])

    def state(lo, last, score, top, hi, most, near, out) -> Column:
        parts = {"lo": lo, "last": last, "score": score, "top": top, "hi": hi, "most": most, "near": near}
        return F.struct(*(v.cast("int").alias(k) for k, v in parts.items()), out.alias("out"))

    def step(s: Column, p: Column) -> Column:
        score = s["score"] - percent * (p - s["last"] - 1)
        begun = state(p, p, F.lit(up), F.lit(up), p, F.lit(up), p, ended(s))
        higher, nearer = score + up >= s["top"], (score + up >= s["most"]) & (p - s["lo"] < words)
        gone_on = state(s["lo"], p, score + up, F.when(higher, score + up).otherwise(s["top"]), F.when(higher, p).otherwise(s["hi"]), F.when(nearer, score + up).otherwise(s["most"]), F.when(nearer, p).otherwise(s["near"]), s["out"])
        return F.when((score <= 0) | (p - s["lo"] >= reach), begun).otherwise(gone_on)

    zero = F.lit(0)
    return F.aggregate(places, state(zero, F.lit(-1), zero, zero, zero, zero, zero, F.array().cast("array<struct<lo: int, hi: int>>")), step, ended)


def _spans(text: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """(row, doc_id, line_no, last_line, license, common, size, template_size) of spans that don't overlap."""

    def pairs(words: Column) -> Column:
        pair = lambda i: F.struct(F.get(words, i - 1)["line"].alias("first"), F.get(words, i)["line"].alias("last"), F.xxhash64(F.get(words, i - 1)["h"], F.get(words, i)["h"]).alias("h"))
        return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), pair))

    words = F.flatten(F.transform(F.split(F.col("text"), "\n", -1), lambda line, k: F.transform(_words(line), lambda w: F.struct((k + 1).alias("line"), F.xxhash64(w).alias("h")))))
    held = text.select("row", "doc_id", "text", F.array_distinct(_pairs(_words(F.col("text")))).alias("own"))
    enough = ((200 - percent) * F.size("own") >= percent * F.size("template")) & F.arrays_overlap("own", "rare") & ((200 - percent) * F.size(F.array_intersect("own", "template")) >= percent * F.size("template"))
    met = held.join(F.broadcast(table), enough).select("row", "doc_id", "license", "variant", F.posexplode(_let(words, pairs)).alias("pos", "pair"))
    marks = table.select("license", "variant", F.explode("template").alias("h"), F.lit(True).alias("hit"))
    met = met.select("row", "doc_id", "license", "variant", "pos", "pair.*").join(F.broadcast(marks), ["license", "variant", "h"], "left")
    each = met.groupBy("row", "doc_id", "license", "variant").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "first", "last", F.col("hit").isNotNull().alias("hit")))).alias("all"))
    each = each.join(F.broadcast(table.select("license", "variant", "words", F.size("template").alias("n"))), ["license", "variant"])
    runs = _cut_out(F.transform(F.filter("all", lambda x: x["hit"]), lambda x: x["pos"]), F.col("n"), F.col("words"), percent)

    def judged(run: Column) -> Column:
        count = lambda part: F.size(F.array_distinct(F.transform(part, lambda x: x["h"])))
        length = F.greatest(run["hi"] - run["lo"] + 1, F.when(F.col("words") < SHORT, F.least(F.col("words") - 1, F.size("all"))))
        part = F.slice("all", F.least(run["lo"], F.size("all") - length) + 1, length)
        ends = run["lo"].alias("lo"), run["hi"].alias("hi"), F.get("all", run["lo"])["first"].alias("line_no"), F.get("all", run["hi"])["last"].alias("last_line")
        return _let(part, lambda p: F.struct(*ends, count(F.filter(p, lambda x: x["hit"])).alias("common"), count(p).alias("size")))

    found = each.select("row", "doc_id", "license", "n", F.explode(F.transform(runs, judged)).alias("s")).where(200 * F.col("s.common") >= percent * (F.col("s.size") + F.col("n")))
    dice = 2 * F.col("s.common") / (F.col("s.size") + F.col("n"))
    fields = ["line_no", "last_line", "license", "common", "size", "template_size"]
    of = F.struct("s.lo", "s.hi", "license", F.struct("s.common", dice.alias("dice")).alias("rank"), "s.line_no", "s.last_line", "s.common", "s.size", F.col("n").alias("template_size"))
    of = found.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set(of)).alias("of"))

    def apart(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        better = F.when(x["rank"] > last["rank"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)
        return F.when(F.size(kept) == 0, F.array(x)).when(last["hi"] < x["lo"], F.concat(kept, F.array(x))).otherwise(better)

    return of.select("row", "doc_id", F.explode(F.aggregate("of", F.slice("of", 1, 0), apart)).alias("s")).select("row", "doc_id", *(f"s.{f}" for f in fields))


def license_matches(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", whole: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, line_no, license, common, size, template_size) of each unit's best template with Dice >= percent / 100, and of spans.

    Texts are put in lower case and cut at what is neither letter nor digit. line_no counts lines from 1; 0 is the
    whole text of a document with several lines; a span has the number of its first line. Dice is
    2 * common / (size + template_size) over distinct bigrams; of equally good templates the first name, then the
    smaller template, wins. Spans are compared with `whole` too, licences' whole texts (bodies() if None); of spans that
    overlap the one with more common bigrams is kept, and none that a unit in it already tells: one with the same
    licence and four fifths of its common bigrams. Null and empty texts match nothing; rows that repeat an id are
    scanned one by one; other columns are ignored. The templates decide the size of what every task gets, not docs.
    """
    spark, whole = docs.sparkSession, bodies() if whole is None else whole
    table = _table(spark, templates, percent)
    every = _table(spark, {n: (*templates.get(n, ()), *whole.get(n, ())) for n in {*templates, *whole}}, percent)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    rare = _rare(table), _rare(every)
    met = _let(_pairs(_words(F.col("text"))), lambda p: F.when(F.arrays_overlap(p, rare[0]), 2).when(F.arrays_overlap(p, rare[1]), 1).otherwise(0))
    text = text.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), met.alias("met")).where("met > 0")
    text = Scratch(spark).write(text)  # read twice, with the same row numbers
    units, spans = _units(text.where("met = 2"), table, percent), _spans(text, every, percent)
    told = units.select(F.col("row").alias("_row"), F.col("license").alias("_license"), F.col("line_no").alias("_line"), F.col("common").alias("_common"))
    same = (F.col("row") == F.col("_row")) & (F.col("license") == F.col("_license")) & (5 * F.col("_common") >= 4 * F.col("common"))
    spans = spans.join(told, same & ((F.col("_line") == 0) | F.col("_line").between(F.col("line_no"), F.col("last_line"))), "left_anti")
    columns = ["doc_id", "line_no", "license", "common", "size", "template_size"]
    return units.select(*columns).unionByName(spans.select(*columns))


def license_sql(templates: dict[str, tuple[str, ...]] = TEMPLATES, percent: int = PERCENT) -> str:
    """The units' rows over a view `documents`, without pruning; spans have no SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {k}, [{', '.join(map(quoted, bigrams_of(t)))}])" for name, texts in sorted(templates.items()) for k, t in enumerate(texts))
    return f"""
    WITH templates(license, variant, template) AS (VALUES {values}),
    lines AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS l, text FROM documents WHERE text IS NOT NULL),
    units AS (
      SELECT r, doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_no, unnest(l) AS line FROM lines
      UNION ALL SELECT r, doc_id, 0, text FROM lines WHERE len(l) > 1),
    words AS (SELECT r, doc_id, line_no, list_filter(string_split(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM units),
    own AS (SELECT r, doc_id, line_no, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS own FROM words),
    met AS (
      SELECT r, doc_id, line_no, license, CAST(len(list_intersect(own, template)) AS INTEGER) AS common, CAST(len(own) AS INTEGER) AS size, CAST(len(template) AS INTEGER) AS template_size
      FROM own JOIN templates ON len(own) > 0)
    SELECT doc_id, line_no, license, common, size, template_size FROM (
      SELECT *, row_number() OVER (PARTITION BY r, line_no ORDER BY common * 1.0 / (size + template_size) DESC, license, template_size) AS k
      FROM met WHERE 200 * common >= {percent} * (size + template_size))
    WHERE k = 1"""
