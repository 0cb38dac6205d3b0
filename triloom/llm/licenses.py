"""License scans in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along directories.

Terms are lower-case runs of letters and digits, weighed by count times idf; the document frequencies of all terms are
counted over all files. A header line is a line with a content term of a header template (any term but the function words); function words
alone are too little of every template to reach its threshold. Passages of 1 to WRAP adjacent header lines (blank lines
between them don't part them) and the file as a whole are compared with the header templates; the whole file meets the full
licence texts in license_texts too. Files are dropped before that only by a bound: by Cauchy and Schwarz, what lacks too much of every template's norm can't reach
a threshold. Passages and the few files left become rows (passage, term); joined with the terms' weights and the
templates' sparse vectors they give norms and dot products, summed by passage and template.

A file whose matching passages hold at least `file_share` of its terms, or that matches as a whole, is a licence file of its
directory. A file without a header of its own inherits from the nearest directory above it, its own included, that has a licence file.

Defined cases: a null or empty text has no licence of its own; a null path lies in the root directory; of equally close
templates the first name wins, of several licence files of a directory the one of the highest cosine, then the first by
path; null ids and repeated rows are scanned row by row; an empty table gives no rows; further columns are ignored. A very long
text is one row's arrays while its terms are counted; only its passages are kept.
"""

from __future__ import annotations

import functools
import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored

# Licence headers, as (SPDX identifier, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
# SPDX tags, which name their licence by few terms and have to match closer.
TAGS = [(name, f"SPDX-License-Identifier: {tag}") for name in ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-2.0", "GPL-3.0", "MIT", "MPL-2.0") for tag in ((name, f"{name}-only", f"{name}-or-later") if name.startswith("GPL") else (name,))]
# Words that make no header line.
FUNCTION_WORDS = "a an and any as at be by can form found if in is it not of one or that the this to under was with work you may".split()
TERM = "[^a-z0-9]+"
#: Lines of the longest passage.
WRAP = 8


@functools.lru_cache(maxsize=1)
def full_texts() -> dict[str, str]:
    """Full licence texts by SPDX identifier, read by the driver."""
    return {p.stem: p.read_text() for p in (Path(__file__).parent / "license_texts").glob("*.txt")}


def terms(text: str) -> list[str]:
    """A to Z in lower case; runs of letters and digits."""
    out, word = [], ""
    for c in text + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "0" <= c <= "9":
            word += c.lower()
        elif word:
            out.append(word)
            word = ""
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_array(lowered: Column) -> Column:
    return F.filter(F.split(lowered, TERM), lambda x: x != "")


def idf(n: int, df: int) -> float:
    """Weight of a term found in df of n files."""
    return math.log((n + 1) / (df + 1)) + 1


def known_templates(templates: list | None = None, whole_texts: dict[str, str] | None = None, threshold: float = 0.75, tag_threshold: float = 0.9) -> list[tuple[str, list[str], bool, float]]:
    """(name, terms, whether it meets whole files only, least cosine) of all templates."""
    headers = [(n, terms(t), False, threshold) for n, t in (TEMPLATES if templates is None else templates)]
    tags = [(n, terms(t), False, tag_threshold) for n, t in TAGS] if templates is None else []
    return headers + tags + [(n, terms(t), True, threshold) for n, t in sorted((full_texts() if whole_texts is None else whole_texts).items())]


def heavy_terms(vector: dict[str, float], least: float) -> tuple[dict[str, float], float]:
    """Squares of a vector's heaviest entries, and the sum of those that must be there for a cosine of `least`, if all others are."""
    total = sum(x * x for x in vector.values())
    taken, rest = {}, total
    for w, x in sorted(vector.items(), key=lambda y: (-y[1], y[0])):
        if rest <= 0.5 * least * least * total:
            break
        taken[w], rest = x * x, rest - x * x
    return taken, least * least * total * (1 - 1e-9) - rest


def scan(files: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: list | None = None, whole_texts: dict[str, str] | None = None, threshold: float = 0.75, tag_threshold: float = 0.9, file_share: float = 0.5, broadcast_dirs: int = 100_000) -> DataFrame:
    """One row per row: id, own_license, own_score, inherited_license, license_dir, license (own, else inherited)."""
    known = known_templates(templates, whole_texts, threshold, tag_threshold)
    vocabulary = sorted({w for _, ws, _, _ in known for w in ws})
    heads = {w for _, ws, full, _ in known if not full for w in ws}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    counts = files.select(F.explode(F.array_distinct(term_array(ascii_lower(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = stored(counts, "license-df")
    n = files.count()
    found = {r["term"]: r["df"] for r in counts.where(F.col("term").isin(vocabulary)).collect()}  # terms of the templates only
    weight = {v: idf(n, found.get(v, 0)) for v in vocabulary}
    vectors = [{w: ws.count(w) * weight[w] for w in set(ws)} for _, ws, _, _ in known]
    sizes = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]

    # function words that could make up a template's threshold by themselves do make header lines
    strange = [v for (_, _, full, least), v, size in zip(known, vectors, sizes, strict=True) if not full and sum(x * x for w, x in v.items() if w in FUNCTION_WORDS) >= (least * size) ** 2 * (1 - 1e-9)]
    content = sorted(heads - (set(FUNCTION_WORDS) - {w for v in strange for w in v}))

    heavy = [heavy_terms(v, least) for (_, _, _, least), v in zip(known, vectors, strict=True)]
    heavy_headers, heavy_full = ([h for h, k in zip(heavy, known, strict=True) if k[2] == full] for full in (False, True))

    def strong(bounds: list) -> list[str]:
        return sorted({w for taken, _ in bounds for w in taken})

    def may_match(words: Column, bounds: list) -> Column:
        """Whether the distinct terms hold enough of some template's heaviest ones."""
        if not bounds:
            return F.lit(False)

        def enough(has: Column) -> Column:
            sums = [(sum((F.when(F.array_contains(has, w), x).otherwise(0.0) for w, x in sorted(taken.items())), F.lit(0.0)) >= least) for taken, least in bounds]
            return functools.reduce(Column.__or__, sums)

        has = F.array(F.array_distinct(F.filter(words, lambda t: t.isin(strong(bounds)))))
        return F.exists(has, lambda h: (F.size(h) > 0) & enough(h))

    def header_lines(lowered: Column) -> Column:
        """Lines with terms: number among them, terms, and whether it is a header line."""
        words = F.filter(F.transform(F.split(lowered, "\n"), term_array), lambda x: F.size(x) > 0)
        return F.transform(words, lambda x, i: F.struct(i.alias("i"), x.alias("terms"), F.exists(x, lambda t: t.isin(content)).alias("header")))

    def passages(lines: Column) -> Column:
        """Runs of 1 to WRAP adjacent header lines that may match."""

        def passage(i: Column, k: int) -> Column:
            part = F.slice(lines, i + 1, k)
            fits = (i + k <= F.size(lines)) & F.forall(part, lambda x: x["header"])
            return F.when(fits, F.struct(i.alias("at"), F.lit(k).alias("lines"), F.flatten(part["terms"]).alias("terms")))

        starts = F.filter(lines, lambda x: x["header"])["i"]
        runs = F.filter(F.flatten(F.transform(starts, lambda i: F.array(*[passage(i, k) for k in range(1, WRAP + 1)]))), lambda x: x.isNotNull())
        return F.filter(runs, lambda x: may_match(x["terms"], heavy_headers))

    kind = "array<struct<at: int, lines: int, terms: array<string>>>"
    none = F.array().cast(kind)
    lowered = ascii_lower(text)
    base = files.select(F.col(id_col).alias("_id"), path.alias("_path"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("_dir"), lowered.alias("_text"), term_array(lowered).alias("_words"))
    base = base.select("_id", "_path", "_dir", F.size("_words").alias("_size"), "_text", "_words", may_match(F.col("_words"), heavy_headers).alias("_may"), may_match(F.col("_words"), heavy_full).alias("_full"))
    lines = F.array(F.when(F.col("_may"), header_lines(F.col("_text"))))
    whole = F.when(F.col("_may") | F.col("_full"), F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("lines"), F.col("_words").alias("terms"))))
    some = F.flatten(F.transform(lines, lambda x: F.coalesce(passages(x), none)))
    sizes_of = F.flatten(F.transform(lines, lambda x: F.coalesce(F.transform(x, lambda y: F.size(y["terms"])), F.array().cast("array<int>"))))
    base = base.select(F.monotonically_increasing_id().alias("_row"), "_id", "_path", "_dir", "_size", F.coalesce(sizes_of, F.array().cast("array<int>")).alias("_lines"), F.concat(F.coalesce(whole.cast(kind), none), F.coalesce(some, none)).alias("_passages"))
    base = stored(base, "license-lines")
    terms_of = base.select("_row", F.explode("_passages").alias("_p")).select("_row", "_p.at", "_p.lines", F.explode("_p.terms").alias("term"))
    terms_of = stored(terms_of.groupBy("_row", "at", "lines", "term").agg(F.count("*").alias("tf")), "license-terms")
    weights = stored(counts.join(terms_of.select("term").distinct(), "term", "left_semi").select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("w")), "license-weights")
    # the templates' sparse vectors, as one literal; its size is that of the templates
    rows = json.dumps([{"term": v, "x": [[k, vector[v]] for k, vector in enumerate(vectors) if v in vector]} for v in vocabulary])
    parts = files.sparkSession.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<term: string, x: array<array<double>>>>")).alias("v")).select("v.term", "v.x")
    few = weights.count() <= broadcast_dirs  # a counted bound
    joined = terms_of.join(F.broadcast(weights) if few else weights, "term").select("*", (F.col("tf") * F.col("w")).alias("y"))
    norms = joined.groupBy("_row", "at", "lines").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    dots = joined.join(F.broadcast(parts), "term").select("_row", "at", "lines", "y", F.explode("x").alias("x")).groupBy("_row", "at", "lines", F.col("x")[0].cast("int").alias("template")).agg(F.sum(F.col("y") * F.col("x")[1]).alias("dot"))
    at = F.col("template")
    order = {name: -k for k, name in enumerate(sorted({name for name, *_ in known}))}
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    scored = dots.join(norms, ["_row", "at", "lines"]).where((F.col("at") < 0) | ~pick([full for _, _, full, _ in known]))
    scored = scored.select("_row", "at", "lines", F.round(F.col("dot") / F.col("norm") / pick(sizes), 9).alias("score"), pick([order[k[0]] for k in known]).alias("rank"), pick([k[0] for k in known]).alias("name"), pick([k[3] for k in known]).alias("least"))
    # a passage of several lines is of the licence that it matches best
    best = scored.where("score >= least").groupBy("_row").agg(F.max(F.struct("score", "rank", "name")).alias("_best"), F.collect_set(F.struct("at", "lines")).alias("_matched"))
    best = stored(best, "license-best")
    scored = base.drop("_passages").join(F.broadcast(best) if best.count() <= broadcast_dirs else best, "_row", "left")
    covered = F.aggregate(F.filter(F.transform("_lines", lambda s, i: F.when(F.exists("_matched", lambda p: (p["at"] <= i) & (i < p["at"] + p["lines"])), s).otherwise(0)), lambda s: s > 0), F.lit(0), lambda a, s: a + s)
    is_file = F.coalesce(F.exists("_matched", lambda p: p["at"] < 0) | (covered >= file_share * F.col("_size")), F.lit(False))
    scored = stored(scored.select("_id", "_path", "_dir", F.col("_best.name").alias("own"), F.col("_best.score").alias("score"), (F.col("_best").isNotNull() & is_file).alias("is_file")), "license-own")
    owners = scored.where("is_file").groupBy("_dir").agg(F.min_by("own", F.struct((-F.col("score")).alias("a"), F.col("_path").alias("b"), F.col("own").alias("c"))).alias("inherited"))
    owners = stored(owners.select(F.col("_dir").alias("above"), "inherited"), "license-dirs")
    # each distinct directory looks up itself and those above it
    steps = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("above")))
    dirs = scored.select("_dir").distinct().select("_dir", F.explode(above).alias("a")).select("_dir", "a.depth", "a.above")
    few = owners.count() <= broadcast_dirs
    nearest = dirs.join(F.broadcast(owners) if few else owners, "above").groupBy("_dir").agg(F.max_by("inherited", "depth").alias("inherited"), F.max_by("above", "depth").alias("license_dir"))
    nearest = stored(nearest, "license-nearest")
    small = nearest.count() <= broadcast_dirs
    out = scored.join(F.broadcast(nearest) if small else nearest, "_dir", "left")
    return out.select(F.col("_id").alias(id_col), F.col("own").alias("own_license"), F.col("score").alias("own_score"), F.col("inherited").alias("inherited_license"), "license_dir", F.coalesce("own", "inherited").alias("license"))
