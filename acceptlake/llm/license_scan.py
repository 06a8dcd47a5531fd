"""License scan: MinHash bands over overlapping word windows retrieve templates, exact shingle containment verifies; DataFrame operations only.

Words are runs of ASCII letters (A-Z lower-cased) and digits; a shingle is two neighbouring words. A template of up to c words
(c: 8, 16, ... ; the least that holds it) is looked for in windows of 2c words that start every c words, so that each
occurrence lies in one window whole. The bands have one row each: a window that holds a template with the wanted
containment has Jaccard similarity of about 0.2 or more to it, and shares one of BANDS minima with probability 1 - 0.8 ** 32 > 0.999.
Only windows that hold one of the words without which no template can reach the containment are made; this loses nothing.

Null, empty and one-word texts match nothing; rows that share an id but not the text are told apart by the text's hash, and repeated
rows count once; ties go to the first window. A very long text is a row of many windows, each with a key of its own. An empty table gives an
empty result; a template without a shingle is refused. Only the id and the text are looked at, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS, CONTAINMENT = 32, 0.8
#: Templates that are broadcast at most; more are refused.
MAX_TEMPLATES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices of public licenses, by SPDX id.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_NO_CLAIM = "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
# Whole texts of public licenses.
TEXTS = [
    (
        "BSD-2-Clause (text)",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC (text)",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT (text)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS {_NO_CLAIM}",
    ),
    (
        "Unlicense (text)",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        f"{_NO_WARRANTY} IN NO EVENT SHALL THE AUTHORS {_NO_CLAIM} For more information, please refer to <https://unlicense.org>",
    ),
]
TEMPLATES = NOTICES + TEXTS


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("([a-z0-9]+)"), F.lit(1))


def shingles(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))


def _minima(hashed: Column) -> list[Column]:
    return [F.min(F.xxhash64(hashed, F.lit(b))).alias(f"m{b}") for b in range(BANDS)]


def _bands() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("least")) for b in range(BANDS)]))


def needles(template: list[str], containment: float) -> list[str]:
    """Words of a template, longest first, without which fewer shingles remain than a match needs."""
    pairs = {(a, b) for a, b in zip(template, template[1:], strict=False)}
    chosen: list[str] = []
    for word in sorted(set(template), key=lambda x: (-len(x), x)):
        if sum(1 for a, b in pairs if a not in chosen and b not in chosen) < containment * len(pairs):
            break
        chosen.append(word)
    return chosen


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and license found: id, license_id, containment (the best window's), n_windows, first_word (of the best window)."""
    spark = docs.sparkSession
    templates = templates if templates is not None else spark.createDataFrame(TEMPLATES, "license_id string, text string")
    known = templates.select("license_id", words(F.col("text")).alias("w")).limit(MAX_TEMPLATES + 1).collect()
    if len(known) > MAX_TEMPLATES or any(len(r.w) < 2 for r in known):
        raise ValueError(f"templates must have two words and be {MAX_TEMPLATES} at most")
    if not known:
        return docs.limit(0).select(F.col(id_col), F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("first_word"))
    steps = {r.license_id: max(8, 1 << (len(r.w) - 1).bit_length()) for r in known}
    table = spark.createDataFrame([(r.license_id, steps[r.license_id], [f"{a} {b}" for a, b in zip(r.w, r.w[1:], strict=False)]) for r in known], "license_id string, step int, shingle array<string>")
    table = table.select("license_id", "step", F.explode(F.array_distinct("shingle")).alias("shingle")).withColumn("h", F.xxhash64("shingle"))
    table = table.groupBy("license_id", "step").agg(F.collect_set("h").alias("t_set"), *_minima(F.col("h")))
    t_bands = table.select("license_id", F.col("step").alias("t_step"), _bands().alias("b")).select("license_id", "t_step", F.col("b.band").alias("t_band"), F.col("b.least").alias("t_least"))
    t_sets = table.select(F.col("license_id").alias("t_license"), "t_set")

    wanted = sorted({x for r in known for x in needles(r.w, containment)})
    test = f"(?i)(?<![a-z0-9])(?:{'|'.join(wanted)})(?![a-z0-9])"
    rows = docs.where(F.col(text_col).rlike(test)).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), words(F.col(text_col)).alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(*wanted), i)), lambda i: i.isNotNull())
    rows = rows.where(F.size("w") > 1).select("id", "own", "w", at.alias("at"))

    # shingles of the windows of 2 * step words, one every step words, that hold a needed word; all steps from one reading of the texts
    step = F.col("step")
    part = rows.select("id", "own", "w", "at", F.explode(F.array(*[F.lit(x) for x in sorted(set(steps.values()))])).alias("step"))
    both = F.flatten(F.transform("at", lambda p: F.array(F.floor(p / step), F.floor(p / step) - 1)))
    part = part.select("id", "own", "w", "step", F.explode(F.array_distinct(F.filter(both, lambda k: k >= 0))).alias("k"))
    part = part.withColumn("w", F.slice("w", (F.col("k") * step + 1).cast("int"), 2 * step)).where(F.size("w") > 1)
    windows = part.select("id", "own", "step", "k", F.explode(shingles(F.col("w"))).alias("h")).withColumn("h", F.xxhash64("h"))
    windows = windows.groupBy("id", "own", "step", "k").agg(F.collect_set("h").alias("set"), *_minima(F.col("h")))
    bands = windows.select("id", "own", "step", "k", "set", _bands().alias("b")).select("id", "own", "step", "k", "set", "b.*")
    met = bands.join(F.broadcast(t_bands), (F.col("band") == F.col("t_band")) & (F.col("least") == F.col("t_least")) & (F.col("step") == F.col("t_step")))
    met = met.dropDuplicates(["id", "own", "step", "k", "license_id"]).join(F.broadcast(t_sets), F.col("license_id") == F.col("t_license"))
    held = met.withColumn("containment", F.size(F.array_intersect("set", "t_set")) / F.size("t_set")).where(F.col("containment") >= containment)
    best = F.max_by(F.struct("containment", (F.col("k") * F.col("step")).alias("first_word")), F.struct("containment", -F.col("k")))
    found = held.groupBy("id", "license_id").agg(best.alias("best"), F.count("*").alias("n_windows"))
    return found.select(F.col("id").alias(id_col), "license_id", "best.containment", "n_windows", F.col("best.first_word").cast("long").alias("first_word"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_VALUES = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in TEMPLATES)
ORACLE = rf"""
WITH t AS (SELECT license_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w FROM (VALUES {_VALUES}) v(license_id, text)),
ts AS (SELECT license_id, CAST(greatest(8, power(2, ceil(log2(len(w))))) AS BIGINT) AS step, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS s FROM t),
steps AS (SELECT DISTINCT step FROM ts),
d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, step, w, unnest(range(0, (len(w) - 2) // step + 1)) AS k FROM d, steps WHERE len(w) > 1),
win AS (SELECT doc_id, step, k, list_slice(w, k * step + 1, (k + 2) * step) AS w FROM k),
ws AS (SELECT doc_id, step, k, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS s FROM win),
m AS (SELECT doc_id, license_id, k, ws.step, len(list_intersect(ws.s, ts.s))::DOUBLE / len(ts.s) AS containment FROM ws JOIN ts ON ts.step = ws.step AND list_has_any(ws.s, ts.s))
SELECT doc_id, license_id, max(containment) AS containment, count(*) AS n_windows, CAST(arg_max(k * step, [containment, -k]) AS BIGINT) AS first_word
FROM m WHERE containment >= {CONTAINMENT} GROUP BY doc_id, license_id
"""

QUERIES = {"op7_license_scan": op7_license_scan}
SQL = {"op7_license_scan": ORACLE}
