"""Licence scan: stretches of text compared with licence notices by the Dice coefficient of word bigrams.

A text falls into units: its lines, and its blocks of several lines between blank ones. Both sides are
normalised to lower-case words of letters and digits and then to the set of pairs of neighbouring
words. Compared are whole units, and inside longer ones all windows of as many words as a template has
(in a block those that cross a line end, as the others are found in the line). Two sets whose sizes
differ too much cannot reach the threshold, and a stretch that reaches it holds a third of the
template's pairs at least: so a few pairs of each template, its anchors, tell which texts, units and
windows need no comparison. All of it is column expressions over one scan of the whole text; nothing
is moved.

Defined results: a null text or one without words has no match. Of stretches that overlap, the one
with the highest coefficient counts, then the smallest name, then the first and shortest; a unit gives
each licence once, with its best coefficient. Repeated rows are scanned each. Very long texts are
scanned whole. Columns of any name may stand beside the text. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import free_name

THRESHOLD = 0.8

# Public licence notices as they are commonly written. The families that differ in a
# name or number only are put together by rule below.
_NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_SHORT = [("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause")]
_GNU = [
    ("GPL", "General Public License", ("2", "3")),
    ("LGPL", "Lesser General Public License", ("2.1", "3")),
    ("AGPL", "Affero General Public License", ("3",)),
]
_COMMONS = [("BY", "Attribution"), ("NC", "NonCommercial"), ("SA", "ShareAlike"), ("ND", "NoDerivatives")]
_COMMONS_KINDS = ["BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND"]


def _templates() -> list[tuple[str, str]]:
    out = list(_NOTICES)
    for name, said in _SHORT:
        out += [(name, f"Released under the {said} License."), (name, f"Licensed under the {said} License.")]
    for name, said, versions in _GNU:
        for version in versions:
            full = f"{name}-{version if '.' in version else version + '.0'}"
            out += [
                (full, f"This work is licensed under the GNU {said}, version {version}."),
                (full, f"Released under the GNU {said} v{version}."),
                (
                    full,
                    "This program is free software: you can redistribute it and/or modify it under the terms of "
                    f"the GNU {said} as published by the Free Software Foundation, either version "
                    f"{version} of the License, or (at your option) any later version.",
                ),
            ]
    words = dict(_COMMONS)
    for kind in _COMMONS_KINDS:
        full, said = "-".join(kind.split()), "-".join(words[k] for k in kind.split())
        out += [
            (f"CC-{full}-4.0", f"Licensed under CC {full} 4.0."),
            (f"CC-{full}-4.0", f"This work is licensed under a Creative Commons {said} 4.0 International License."),
        ]
    return out


TEMPLATES = _templates()


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(text: str, threshold: float = THRESHOLD) -> list[str]:
    """Pairs of a template of which every stretch that reaches the threshold holds one.

    It holds threshold / (2 - threshold) of them at least, so one more than it may lack are enough;
    the longest are the rarest.
    """
    grams = template_bigrams(text)
    held = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
    return sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - held + 1]


def _anchored(templates: list[tuple[str, str]], threshold: float) -> str:
    """A pattern that finds an anchor of some template in a lower-case text.

    Words that begin alike share their beginning, so few alternatives are tried at a place.
    """
    pairs = {g for _, text in templates for g in anchors(text, threshold)}

    def shared(rest: set[str], depth: int) -> str:
        if depth == 0 or len(rest) == 1 or not all(rest):
            return "(?:" + "|".join(sorted(rest)) + ")"
        heads: dict[str, set[str]] = {}
        for r in rest:
            heads.setdefault(r[0], set()).add(r[1:])
        parts = [h + shared(r, depth - 1) for h, r in sorted(heads.items())]
        return "(?:" + "|".join(parts) + ")"

    return r"(?<![\p{L}\p{N}])" + shared(pairs, 2).replace(" ", r"[^\p{L}\p{N}]+")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _known(templates: list[tuple[str, str]], threshold: float) -> str:
    rows = []
    for name, text in templates:
        grams = template_bigrams(text)
        listed, marks = (", ".join(map(_quoted, x)) for x in (grams, anchors(text, threshold)))
        rows.append(
            f"named_struct('name', {_quoted(name)}, 'n', {len(grams)}, 'm', {len(template_words(text))}, "
            f"'grams', array({listed}), 'anchors', array({marks}))"
        )
    return f"array({', '.join(rows)})"


def _units(text: Column) -> Column:
    """(kind, at, words): lines and blocks with their words, each with the number of its line."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")

    def parts(kind: str, pattern: str) -> Column:
        return F.transform(
            F.split(plain, pattern, -1),
            lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), p.alias("body")),
        )

    blocks = F.filter(parts("block", "\n *(?:\n *)+"), lambda p: F.contains(p["body"], F.lit("\n")))

    def words(unit: Column) -> Column:
        return F.flatten(
            F.transform(
                F.split(unit["body"], "\n", -1),
                lambda line, l: F.transform(
                    F.filter(F.split(line, " ", -1), lambda w: w != ""),
                    lambda w: F.struct(w.alias("w"), l.alias("l")),
                ),
            )
        )

    return F.transform(
        F.concat(parts("line", "\n"), blocks),
        lambda u: F.struct(u["kind"].alias("kind"), u["at"].alias("at"), u["body"].alias("body"), words(u).alias("words")),
    )


def _least(a: Column, b: Column) -> Column:
    return F.when(a < b, a).otherwise(b)


def _stretches(unit: Column, template: Column, threshold: float) -> Column:
    """(dice, license, start, len) of the unit's stretches that reach the threshold with a template."""
    words, grams, width = unit["words"], unit["grams"], F.size(unit["words"])

    def scored(start: Column, length: Column) -> Column:
        own = F.array_distinct(F.slice(grams, start + 1, length - 1))
        shared = F.size(F.array_intersect(own, template["grams"]))
        return F.struct(
            (2.0 * shared / (template["n"] + F.size(own))).alias("dice"), template["name"].alias("license"),
            start.alias("start"), length.alias("len"),
        )

    places = F.filter(
        F.transform(grams, lambda g, i: F.when(F.array_contains(template["anchors"], g), i)), lambda i: i.isNotNull()
    )
    last = width - template["m"]
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                places,
                lambda i: F.sequence(
                    F.when(i - template["m"] + 2 > 0, i - template["m"] + 2).otherwise(F.lit(0)), _least(i, last)
                ),
            )
        )
    )
    # A window that begins before the last place for one: others would run out of the unit.
    inside = F.filter(starts, lambda s: (s >= 0) & (s <= last))
    crossing = F.filter(
        inside,
        lambda s: (unit["kind"] == "line") | (F.get(words, s)["l"] != F.get(words, s + template["m"] - 1)["l"]),
    )
    windows = F.when(last > 0, F.transform(crossing, lambda s: scored(s, template["m"])))
    whole = F.array(scored(F.lit(0), width))
    fits = 2 * F.least(template["n"], F.size(F.array_distinct(grams))) >= threshold * (
        template["n"] + F.size(F.array_distinct(grams))
    )
    none = F.array().cast("array<struct<dice:double,license:string,start:int,len:int>>")
    every = F.concat(F.coalesce(windows, none), F.when(fits, whole).otherwise(none))
    return F.filter(every, lambda c: c["dice"] >= threshold)


def matches(
    text: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> Column:
    """An array of (kind, at, license, dice): what the units hold, lines first, numbered from 0."""
    anchored = _anchored(templates, threshold)
    known = F.expr(_known(templates, threshold))
    asked = F.filter(_units(text), lambda u: F.rlike(u["body"], F.lit(anchored)) & (F.size(u["words"]) > 1))
    units = F.transform(
        asked,
        lambda u: F.struct(
            u["kind"].alias("kind"), u["at"].alias("at"), u["words"].alias("words"),
            F.zip_with(
                F.slice(u["words"], 1, F.size(u["words"]) - 1), F.slice(u["words"], 2, F.size(u["words"])),
                lambda a, b: F.concat(a["w"], F.lit(" "), b["w"]),
            ).alias("grams"),
        ),
    )

    every = sorted({g for _, t in templates for g in anchors(t, threshold)})
    marks = F.expr(f"array({', '.join(map(_quoted, every))})")

    def marked(u: Column) -> Column:
        return F.struct(u["kind"].alias("kind"), u["at"].alias("at"), u["words"].alias("words"),
                        u["grams"].alias("grams"), F.array_intersect(u["grams"], marks).alias("held"))

    def reached(u: Column) -> Column:
        near = F.filter(known, lambda t: F.arrays_overlap(u["held"], t["anchors"]))
        return F.struct(
            u["kind"].alias("kind"), u["at"].alias("at"),
            F.flatten(F.transform(near, lambda t: _stretches(u, t, threshold))).alias("held"),
        )

    def better(a: Column, b: Column) -> Column:
        """Whether a goes before b where they overlap."""
        rank = [(b["dice"], a["dice"]), *((a[f], b[f]) for f in ("license", "start", "len"))]
        out = F.lit(False)
        for low, high in reversed(rank):
            out = (low < high) | ((low == high) & out)
        return out

    def kept(u: Column) -> Column:
        best = F.filter(
            u["held"],
            lambda c: ~F.exists(
                u["held"],
                lambda d: (d["start"] < c["start"] + c["len"]) & (c["start"] < d["start"] + d["len"]) & better(d, c),
            ),
        )
        names = F.array_sort(F.array_distinct(F.transform(best, lambda c: c["license"])))
        return F.transform(
            names,
            lambda n: F.struct(
                u["kind"].alias("kind"), u["at"].alias("at"), n.alias("license"),
                F.array_max(F.transform(F.filter(best, lambda c: c["license"] == n), lambda c: c["dice"])).alias("dice"),
            ),
        )

    found = F.flatten(F.transform(F.transform(F.transform(units, marked), reached), kept))
    none = F.array().cast("array<struct<kind:string,at:int,license:string,dice:double>>")
    return F.when(F.rlike(F.lower(text), F.lit(anchored)), found).otherwise(none)


def scanned(docs: DataFrame, text: str = "text", out: str = "matches") -> DataFrame:
    """The input's columns and, behind them, the matches; a column that is called like `out` stays."""
    return docs.select("*", matches(F.col(f"`{text}`")).alias(free_name(docs, out)))
