"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased. A window is WINDOW shingles of five words in a row (eight words), and
its keys are the minima of its shingles under MINIMA hashes; neighbouring windows share most of them. A window that lies
in an unchanged stretch of eight words of a template is equal to one of the template's windows, so both keys collide with
probability 1. Of n shingles a text that is to count lacks n / 5 at most, which part the others into n / 5 + 1 stretches;
the longest has WINDOW shingles unless the template is short, and for those where it may not, the windows are single
shingles. So every pair that counts is retrieved. A template of fewer than five words is one shingle, which is looked for
at each place of a text where one such template's first word stands. A retrieved pair counts if the text contains AT of
OF of the template's shingles.
Null and empty texts match nothing; rows that repeat an id are one document; rows without an id match nothing; very
long texts are one array of words; an empty table gives no rows. Only the id and the text are read, so that other
columns, of any name, change nothing. DataFrame functions only; the documents are scanned twice (the second time those
with candidates) and never shuffled, as long as the candidates' ids are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialise

SHINGLE, WINDOW, MINIMA = 5, 4, 2
AT, OF = 80, 100
#: Up to so many keys of templates, a text's keys are intersected with them before they become rows.
LITERALS = 20_000

#: Notices and texts of public licenses, without names and years.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-notice": "Released under the MIT License",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

PARTS = r"[\x00-/:-@\[-`{-\x7f]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), PARTS), "")


def _run(w: Column, i: Column | int) -> Column:
    """Hash of five words from i on, or of those there are. (Slices would copy the whole array each.)"""
    return F.xxhash64(*[F.get(w, F.lit(i) + k if isinstance(i, int) else i + k) for k in range(SHINGLE)])


def shingles(w: Column) -> Column:
    """Hashes of all runs of five words; of fewer words, of the whole sequence; none of no word."""
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: _run(w, i))).otherwise(F.array().cast("array<bigint>"))


def short_runs(w: Column, short: dict[int, list[str]]) -> Column:
    """Hashes of the runs of n words that start with a given word, for each n below SHINGLE and its first words."""
    none = F.array().cast("array<bigint>")
    run = lambda n: lambda i: F.xxhash64(*[F.get(w, i + k) if k < n else F.lit(None).cast("string") for k in range(SHINGLE)])
    places = lambda n, first: F.filter(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.get(w, i).isin(*first))
    return F.concat(none, *[F.when(F.size(w) >= n, F.transform(places(n, first), run(n))).otherwise(none) for n, first in sorted(short.items())])


def minima(x: Column) -> Column:
    """Distinct minima of all windows of shingles (of all shingles, where they are fewer), for all hashes."""
    last = F.greatest(F.size(x) - WINDOW, F.lit(0))
    hashed = F.transform(F.array(*map(F.lit, range(MINIMA))), lambda seed: F.transform(x, lambda v: F.xxhash64(v, seed)))
    lowest = F.transform(hashed, lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(h, i + k) for k in range(WINDOW)])))
    return F.when(F.size(x) > 0, F.array_distinct(F.flatten(lowest))).otherwise(F.array().cast("array<bigint>"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df's id with these columns, computed once for each row: a generator of one row keeps them from being copied into the lambdas that use them."""
    return df.select("id", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("s")).select("id", *[F.col(f"s.{k}").alias(k) for k in columns])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Rows (id, license, n_shared, n_shingles, containment): the templates that a document contains."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
    known = materialise(rows.select("license", "w", shingles(F.col("w")).alias("x")).where(F.size("x") > 0))
    lacks = F.floor(F.size("x") * (OF - AT) / OF)
    longest = F.ceil((F.size("x") - lacks) / (lacks + 1))
    by_key = materialise(known.select("license", F.explode(F.when(longest < WINDOW, F.col("x")).otherwise(minima(F.col("x")))).alias("key")).distinct())
    short: dict[int, list[str]] = {}
    for r in known.select(F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first")).where(F.col("n") < SHINGLE).distinct().orderBy("n", "first").collect():
        short.setdefault(r.n, []).append(r.first)
    by_shingle = materialise(known.select("license", F.size(F.array_distinct("x")).alias("n_shingles"), F.explode(F.array_distinct("x")).alias("v")))
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("id IS NOT NULL")
    split = _once(own, w=words(F.col("text")))
    x = _once(split, x=F.when(F.size("w") >= SHINGLE, shingles(F.col("w"))).otherwise(F.array().cast("array<bigint>")), short=short_runs(F.col("w"), short))
    keys = F.concat("x", "short", minima(F.col("x")))
    some = [r.key for r in by_key.select("key").distinct().limit(LITERALS + 1).collect()]
    if len(some) <= LITERALS:
        keys = F.array_intersect(keys, F.lit(sorted(some)) if some else F.array().cast("array<bigint>"))
    found = materialise(x.select("id", keys.alias("keys")).where(F.size("keys") > 0).select("id", F.explode("keys").alias("key")).join(if_small(by_key), "key").select("id", "license").distinct())
    ids = found.select("id").distinct()
    again = x.join(if_small(materialise(ids)), "id", "left_semi") if found.head(1) else x.where(F.lit(False))
    shared = again.select("id", F.explode(F.array_distinct(F.concat("x", "short"))).alias("v")).join(if_small(by_shingle), "v")
    counted = shared.groupBy("id", "license", "n_shingles").agg(F.count_distinct("v").alias("n_shared"))
    verified = counted.where(F.col("n_shared") * OF >= F.col("n_shingles") * AT).join(found, ["id", "license"], "left_semi")
    return verified.select(F.col("id").alias(id_col), "license", F.col("n_shared").cast("bigint"), F.col("n_shingles").cast("bigint"), F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def oracle() -> str:
    """The same containment by SQL over all shingles of all documents, and over all runs as long as a template of fewer than five words."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in TEMPLATES.items())
    cut = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '{PARTS}'), lambda w: w <> '')"
    runs = lambda c, n: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))"
    short = "".join(f" UNION SELECT doc_id, s FROM (SELECT doc_id, unnest({runs('w', n)}) AS s FROM dw WHERE len(w) >= {n}) WHERE s IN (SELECT s FROM ts)" for n in range(1, SHINGLE))
    return f"""
WITH t(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {cut('text')} AS w FROM t),
ts AS (SELECT DISTINCT license, unnest(CASE WHEN len(w) >= 5 THEN {runs('w', 5)} ELSE [array_to_string(w, ' ')] END) AS s FROM tw),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT doc_id, {cut('text')} AS w FROM documents),
ds AS (SELECT doc_id, unnest({runs('w', 5)}) AS s FROM dw WHERE len(w) >= 5{short})
SELECT ds.doc_id, ts.license, count(DISTINCT ds.s) AS n_shared, tn.n AS n_shingles, round(count(DISTINCT ds.s) / tn.n, 6) AS containment
FROM ds JOIN ts ON ds.s = ts.s JOIN tn ON tn.license = ts.license
GROUP BY ds.doc_id, ts.license, tn.n HAVING count(DISTINCT ds.s) * {OF} >= tn.n * {AT}"""
