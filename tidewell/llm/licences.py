"""License scans by sparse TF-IDF cosine, with nearest-ancestor inheritance; DataFrame functions only.

Units are the lines, the sentences and the paragraphs of a whole text, and the whole text of a file named like a
licence. A unit's terms (words, and numbers with their points, without `STOP` words) are weighted by 1 + ln of their
count and the inverse document frequency over the templates: whole licence texts, their paragraphs, customary notices
and every SPDX line, a fixed list, so its table may be broadcast. A document's licence is the template with the
largest cosine over its units, if that reaches `THRESHOLD` with at least `LEAST_TERMS` common terms. An SPDX line that
names several licences counts as one for each, a unit that denies a licence ("is not licensed under") as none. Neighbouring versions and
variants have templates too, so that they aren't taken for the nearest common one. A document without
one takes that of the licence file in its nearest ancestor directory: directories, not documents, are joined with the
licence files' directories.

A cosine is at most the length of the template's part that the unit shares. So a unit that shares too little with
every template can't reach the threshold and is left out; and a text without any word of `cue`, which every unit that
can reach it has, isn't split. Nothing else is left out. Sums combine before they are shuffled, and documents meet what
their directories inherit by a broadcast of a checked size, or else by salted keys, so no directory is one task.

Cases: a null or empty text has no licence of its own; `RESERVED` yields to every other licence; ties go to the first template in order; of two licence files
in one directory the larger score counts, then the smaller path, then the first template; null paths inherit nothing;
repeated rows get equal answers; an empty table gives no rows; extra columns are ignored; long texts count whole.
"""

from __future__ import annotations

import json
import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# Public licence texts, the customary notices of licences, and SPDX identifiers.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_4 = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_END = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."

TEXTS: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_NOTICE} {_AS_IS}"),
    ("MIT", _MIT_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_END}"),
    ("Apache-2.0", _APACHE_END),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD_1} {_BSD_2}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1} {_BSD_2}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_1} {_BSD_2} {_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_3}"),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("0BSD", _ZERO),
    ("0BSD", f"{_ZERO} {_ISC_END}"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE} {_UNLICENSE_REST}"),
    ("BSD-4-Clause", f"{_BSD} {_BSD_1} {_BSD_2} {_BSD_4} {_BSD_3} {_BSD_END}"),
    ("BSD-4-Clause", _BSD_4),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-1.0", "Licensed under the Apache License, Version 1.0."),
    *[(f"MPL-{x}", f"Mozilla Public License, version {x}") for x in ("2.0", "1.1", "1.0")],
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
    ("MPL-1.0", "The contents of this file are subject to the Mozilla Public License Version 1.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Proprietary", "Copyright. All rights reserved."),
]
GNU: list[tuple[str, str, str, str]] = [
    ("GPL-1.0", "General", "1", "February 1989"),
    ("LGPL-2.0", "Library General", "2", "June 1991"),
    ("GPL-2.0", "General", "2", "June 1991"),
    ("GPL-3.0", "General", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero General", "3", "19 November 2007"),
]
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CREATIVE_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}
SPDX = "MIT Apache-2.0 Apache-1.1 Apache-1.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC 0BSD Unlicense MPL-2.0 MPL-1.1 MPL-1.0 CC0-1.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split()
STOP = "a all an and any are as at be by can for from if in into is it its of on only or that the this to under was will with you your which such may not no version v".split()


def _templates() -> list[tuple[str, str]]:
    """The texts, then notices of GNU licences and SPDX lines by rule."""
    out = list(TEXTS)
    for name, kind, version, date in GNU:
        title = f"GNU {kind} Public License"
        terms = f"you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation"
        out += [(name, f"This work is licensed under the {title}, version {version}."), (name, f"{title} Version {version}, {date}")]
        for what in ("This program", "This library"):
            out += [(name, f"{what} is free software: {terms}, either version {version} of the License, or (at your option) any later version."), (name, f"{what} is free software; {terms}; version {version}.")]
    for kind, long in CREATIVE.items():
        for version, port in CREATIVE_VERSIONS.items():
            out += [(f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}."), (f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {long} {version} {port} License."), (f"CC-{kind}-{version}", f"SPDX-License-Identifier: CC-{kind}-{version}")]
    for name in SPDX:
        out += [(name, f"SPDX-License-Identifier: {name}{tail}") for tail in (("-only", "-or-later", "") if "GPL" in name else ("",))]
    return out


TEMPLATES = _templates()
#: Words, and numbers with their points; the parts of a licence's variant stay together, as prose is full of their letters.
TERM, THRESHOLD, LEAST_TERMS = r"by(?:-(?:nc|nd|sa))+|[a-z]+|[0-9]+(?:\.[0-9]+)*", 0.6, 2
SLACK = 1e-4  # for the rounding of scores
BLANK = "[ \\t\\r\\f\\n]"
#: An SPDX line whose expression names several licences stands for one line each; a line that denies a licence is none.
JOINED = r"(?i)[ ()]+(?:AND|OR)[ ()]+"
EXPRESSION, DENIED = r"(?i)^(.*SPDX-License-Identifier:)(.*[ (](?:AND|OR)[ (].*)$", r"(?i)\bnot\s+(?:\w+\s+)?(?:licensed|released)\b"
LINE, SENTENCE, PARAGRAPH, FILE_NAME = r"\n", rf"(?<=[.!?]){BLANK}+", rf"\n{BLANK}*\n", r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
RESERVED = "Proprietary"  # reserved rights stand in granting notices too: they count where no other licence reaches the threshold
SMALL = 200_000  # rows of two directories and a licence that may be broadcast
SALTS = 64


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in STOP]


def template_weights() -> tuple[list[dict], float]:
    """(template, licence, term, its part of the unit vector and its idf) rows, and the idf of other terms."""
    bags = [terms_of(text) for _, text in TEMPLATES]
    n, sets = len(bags), [set(b) for b in bags]
    idf = {t: log((n + 1) / (sum(t in b for b in sets) + 1)) + 1 for t in sorted(set().union(*sets))}
    rows = []
    for i, ((licence, _), bag) in enumerate(zip(TEMPLATES, bags, strict=True)):
        w = {t: (1 + log(bag.count(t))) * idf[t] for t in sorted(set(bag))}
        norm = sqrt(sum(x * x for x in w.values()))
        rows += [{"template": i, "licence": licence, "term": t, "part": x / norm, "idf": idf[t]} for t, x in w.items()]
    return rows, log(n + 1) + 1


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of literals, made in the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _squares() -> list[dict[str, float]]:
    """Of each template, the squares of its terms' parts, the shortest term first."""
    bags: dict[int, list[dict]] = {}
    for r in template_weights()[0]:
        bags.setdefault(r["template"], []).append(r)
    return [{r["term"]: r["part"] ** 2 for r in sorted(bag, key=lambda r: (len(r["term"]), r["idf"], r["term"]))} for bag in bags.values()]


def any_of(words: list[str]) -> str:
    """A pattern of the words as a tree of their first letters, so that most text fails at its first letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h) + (any_of(rest) if rest != [""] else "") for h, rest in heads.items() if h]
    inner = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{inner})?" if "" in heads else inner


def cue(threshold: float) -> str:
    """A pattern that a lower-case unit must match to reach the threshold: of each template, all terms but the shortest (prose
    has many of those): those that stay below it together, and one at least, as a unit shares `LEAST_TERMS` terms or more."""
    least, kept = max(threshold, 0) ** 2 - SLACK, set()
    for squares in _squares():
        without = 0.0
        for i, (term, x) in enumerate(squares.items()):
            without += x
            if without >= least and i >= LEAST_TERMS - 1:
                kept.add(term)
    words, numbers = ([t for t in kept if t[0].isdigit() == digits] for digits in (False, True))
    sides = [f"(?<![{c}]){any_of(own)}(?![{c}])" for own, c in ((words, "a-z"), (numbers, "0-9")) if own]
    return "|".join(sides) if threshold > 0 else ""


def units(text: Column, whole: Column, threshold: float = THRESHOLD) -> Column:
    """The distinct stretches of a text that can reach the threshold."""
    can, least = cue(threshold), max(threshold, 0) ** 2 - SLACK
    by_term: dict[str, dict[str, float]] = {}
    for i, squares in enumerate(_squares()):
        for term, x in squares.items():
            by_term.setdefault(term, {})[str(i)] = x
    table = F.from_json(F.lit(json.dumps(by_term)), "map<string,map<string,double>>")
    none = F.array().cast("array<string>")
    parts = F.concat(F.split(text, LINE), F.split(text, SENTENCE), F.split(text, PARAGRAPH), F.when(whole, F.array(text)).otherwise(none))
    some = F.filter(F.array_distinct(parts), lambda u: F.lower(u).rlike(can))
    each = lambda u: F.transform(F.split(F.regexp_extract(u, EXPRESSION, 2), JOINED), lambda x: F.concat(F.regexp_extract(u, EXPRESSION, 1), F.lit(" "), x))
    some = F.flatten(F.transform(some, lambda u: F.when(u.rlike(EXPRESSION), each(u)).otherwise(F.array(u))))
    some = F.filter(F.array_distinct(some), lambda u: ~u.rlike(DENIED))
    known = lambda u: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(u), F.lit(TERM), F.lit(0))), lambda t: F.map_contains_key(table, t))
    shared = F.transform(some, lambda u: F.struct(u.alias("u"), F.flatten(F.transform(known(u), lambda t: F.map_entries(F.element_at(table, t)))).alias("e")))
    total = lambda e, i: F.aggregate(F.filter(e, lambda x: x["key"] == i), F.lit(0.0), lambda a, x: a + x["value"])
    reach = F.filter(shared, lambda s: F.exists(F.array_distinct(F.transform(s["e"], lambda x: x["key"])), lambda i: total(s["e"], i) >= least))["u"]
    return F.when(F.lower(text).rlike(can), reach).otherwise(none)


def best_matches(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, licence, score, order, licences) of every (id, units) row with a unit that reaches the threshold."""
    spark = rows.sparkSession
    weights, other = template_weights()
    table = F.broadcast(_table(spark, weights, "template:int,licence:string,term:string,part:double,idf:double"))  # a fixed list
    known = F.broadcast(_table(spark, [dict(t) for t in sorted({(("term", r["term"]), ("idf", r["idf"])) for r in weights})], "term:string,idf:double"))
    terms = rows.select("id", F.posexplode("units").alias("unit", "u")).select("id", "unit", F.explode(F.regexp_extract_all(F.lower("u"), F.lit(TERM), F.lit(0))).alias("term"))
    counted = terms.where(~F.col("term").isin(*STOP)).groupBy("id", "unit", "term").agg(F.count("*").alias("k"))
    weighed = counted.join(known, "term", "left").withColumn("w", (1 + F.ln("k")) * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy("id", "unit").agg(F.sqrt(F.sum(F.round(F.col("w") * F.col("w"), 9))).alias("norm"))
    dots = weighed.join(table.select("template", "licence", "term", "part"), "term").groupBy("id", "unit", "template", "licence").agg(F.sum(F.round(F.col("w") * F.col("part"), 9)).alias("dot"), F.count("*").alias("common"))
    scored = dots.where(F.col("common") >= LEAST_TERMS).join(norms, ["id", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    largest = F.max(F.struct((F.col("licence") != RESERVED).alias("granted"), "score", (-F.col("template")).alias("order"), "licence"))
    best = scored.groupBy("id", "unit").agg(largest.alias("x")).groupBy("id").agg(F.max("x").alias("x"), F.collect_set("x.licence").alias("all"))  # names of licences
    names = F.array_join(F.array_sort(F.when(F.size("all") > 1, F.array_remove("all", RESERVED)).otherwise(F.col("all"))), ",")
    return best.select("id", F.col("x.licence").alias("licence"), F.col("x.score").alias("score"), F.col("x.order").alias("order"), names.alias("licences"))


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """One row per file: key, path, licence, score, origin (`header`, `file`, `inherited` or null), from_dir, the
    directory inherited from, and licences, the names of all that its own units are nearest to."""
    scratch = Scratch(files.sparkSession, "licences")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.col(key).alias("key"), F.col(path).cast("string").alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("whole", F.coalesce(name.rlike(FILE_NAME), F.lit(False)))
    rows = rows.select("key", "path", "whole", units(F.col("text"), F.col("whole"), threshold).alias("units"))
    rows = scratch.table("units", rows.withColumn("id", F.when(F.size("units") > 0, F.md5(F.array_join("units", "\x01")))))  # equal units are scored once
    distinct = rows.where("id is not null").groupBy("id").agg(F.first("units").alias("units"))
    best = scratch.table("best", best_matches(distinct, threshold))
    placed = rows.select("key", "path", "whole", "id", _directory().alias("dir"))
    lone = placed.where("id is null").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("licence", "string"), ("score", "double"), ("order", "int"), ("licences", "string"))])
    own = placed.where("id is not null").join(best, "id", "left").select(*lone.columns).union(lone)
    # The negated order and path rank: a larger score, then the smaller path, then the first template.
    found = own.where("whole and licence is not null and dir is not null").groupBy("dir", "path").agg(F.max(F.struct("score", "order", "licence")).alias("x"))
    found = found.groupBy("dir").agg(F.min(F.struct((-F.col("x.score")).alias("less"), "path", F.col("x.licence").alias("licence"))).alias("x")).select("dir", F.col("x.licence").alias("licence"), (-F.col("x.less")).alias("score"))
    lacking = own.where("licence is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = lacking.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))).alias("a")).select("dir", "a.level", "a.up")
    near = above.join(found.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("level", "up", "licence", "score")).alias("x"))
    near = scratch.table("near", near.select("dir", F.col("x.up").alias("from_dir"), F.col("x.licence").alias("above"), F.col("x.score").alias("above_score")))
    if near.count() <= small:
        joined = own.join(F.broadcast(near), "dir", "left")
    else:
        salt = F.array(*[F.lit(i) for i in range(SALTS)])
        joined = own.withColumn("salt", F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int")).join(near.withColumn("salt", F.explode(salt)), ["dir", "salt"], "left")
    origin = F.when(F.col("licence").isNotNull(), F.when(F.col("whole"), "file").otherwise("header")).when(F.col("above").isNotNull(), "inherited")
    return joined.select(
        F.col("key").alias(key), "path", F.coalesce("licence", "above").alias("licence"), F.coalesce("score", "above_score").alias("score"),
        origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"), "licences",
    )


def _directory() -> Column:
    """The path without its last part; the root is the empty text."""
    return F.regexp_replace("path", "/?[^/]*$", "")
