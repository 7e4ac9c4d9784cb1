"""License scans against SQL without a prefilter, known licence texts, and inheritance on a small tree."""

import math
import re
from collections import Counter

import pytest

from tidewell.llm import licences

MIT_FILE = f"MIT License\n\nCopyright (c) 2020 Some One\n\n{licences._MIT}\n\n{licences._MIT_NOTICE}\n\n{licences._AS_IS}\n"
BSD2_FILE = f"Copyright (c) 2020, Some One\nAll rights reserved.\n\n{licences._BSD}\n\n{licences._BSD_1}\n\n{licences._BSD_2}\n\n{licences._BSD_END}\n"
BSD3_FILE = BSD2_FILE.replace(licences._BSD_2, f"{licences._BSD_2}\n\n{licences._BSD_3}")
ISC_FILE = f"Copyright 2020 Some One\n\n{licences._ISC}\n\n{licences._ISC_END}\n"
SPDX = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "CC0-1.0", "Unlicense", "0BSD"]


def scanned(spark, rows, **more):
    df = licences.scan(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string"), **more)
    return {r.doc_id: r for r in df.collect()}


def test_whole_licence_files(spark):
    names = {"MIT": MIT_FILE, "BSD-2-Clause": BSD2_FILE, "BSD-3-Clause": BSD3_FILE, "ISC": ISC_FILE}
    got = scanned(spark, [("/LICENSE", t) for t in names.values()] + [("/x.c", f"/*\n{t}*/\ncode") for t in names.values()])
    assert [got[i].licence for i in range(8)] == [*names, *names]
    assert all(got[i].score > 0.9 and got[i].origin == "file" for i in range(4))


def test_spdx_lines(spark):
    family = [re.sub("-(only|or-later)$", "", x) for x in SPDX]
    got = scanned(spark, [("/a.c", f"// SPDX-License-Identifier: {x}\nint main;") for x in SPDX] + [("/a.c", "// SPDX-License-Identifier: Unheard-Of-7.0")])
    assert [got[i].licence for i in range(len(SPDX))] == family and got[len(SPDX)].licence is None


def test_notices(spark):
    lines = {
        "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Proprietary": "All rights reserved.", "BSD-2-Clause": "BSD-2-Clause", "MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    }
    got = scanned(spark, [(None, f"stone and weir\n{x}\nmill") for x in lines.values()] + [(None, x) for x in ("Mit.", "Version 2.0", "Released into the wild.", "plain water", "", None)])
    assert [got[i].licence for i in range(len(lines))] == list(lines)
    assert all(got[i].licence is None for i in range(len(lines), len(got)))


def test_neighbouring_versions_expressions_and_denials(spark):
    gnu = "This work is licensed under the GNU General Public License, version"
    lines = {
        "// SPDX-License-Identifier: GPL-1.0-only": "GPL-1.0", "// SPDX-License-Identifier: LGPL-2.0-only": "LGPL-2.0", "# SPDX-License-Identifier: BSD-4-Clause": "BSD-4-Clause", "Licensed under CC BY 3.0.": "CC-BY-3.0",
        "CC BY-ND 4.0": "CC-BY-ND-4.0", "CC BY 4.0": "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": "MPL-1.1", "Mozilla Public License, v. 2.0": "MPL-2.0", f"{gnu} 1.": "GPL-1.0", f"{gnu} 2.": "GPL-2.0", f"{gnu} 3.": "GPL-3.0", "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
        "It is not licensed under the GNU General Public License, version 3.": None, "This is NOT released under the MIT License.": None, licences._BSD_4: "BSD-4-Clause",
    }
    both = ["SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: (MIT AND (ISC OR BSD-3-Clause))\r", "SPDX-License-Identifier: GPL-2.0-only\nReleased under the MIT License.\nAll rights reserved."]
    got = scanned(spark, [(None, f"stone\n{x}\nweir") for x in [*lines, *both]])
    assert [got[i].licence for i in range(len(lines))] == list(lines.values())
    assert [got[len(lines) + i].licences for i in range(3)] == ["Apache-2.0,MIT", "BSD-3-Clause,ISC,MIT", "GPL-2.0,MIT"]
    assert got[len(lines)].score == 1.0 and got[3].licences == "CC-BY-3.0"


def plain_score(text):
    """The best (score, template) of a unit, by weights made here."""
    bag = lambda x: Counter(t for t in re.findall(r"by(?:-(?:nc|nd|sa))+|[a-z]+|[0-9]+(?:\.[0-9]+)*", x.lower()) if t not in licences.STOP)
    bags, n = [bag(x) for _, x in licences.TEMPLATES], len(licences.TEMPLATES)
    idf = lambda t: math.log((n + 1) / (sum(t in b for b in bags) + 1)) + 1
    vector = lambda b: {t: (1 + math.log(k)) * idf(t) for t, k in b.items()}
    own, best = vector(bag(text)), (0.0, 0)
    for i, b in enumerate(bags):
        v = vector(b)
        if len(own.keys() & v.keys()) >= licences.LEAST_TERMS:
            best = max(best, (sum(own[t] * v[t] for t in own.keys() & v.keys()) / math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in v.values())), -i))
    return best


def test_units_of_template_pieces_need_no_prefilter(spark):
    import random

    pick, rows = random.Random(2), []
    for _, text in licences.TEMPLATES * 2:
        words = text.split()
        a = pick.randrange(len(words))
        rows.append(" ".join([*pick.choices(["stone", "weir", "the", "version", "3"], k=pick.randrange(3)), *words[a : a + pick.randrange(2, 40)]]).replace(". ", " ").replace("! ", " ").replace("? ", " "))
    got = scanned(spark, [(None, r) for r in rows])
    for i, r in enumerate(rows):
        score, at = plain_score(r)
        if score >= licences.THRESHOLD + 1e-5:
            assert got[i].licence == licences.TEMPLATES[-at][0] and abs(got[i].score - score) < 1e-4
        elif score < licences.THRESHOLD - 1e-5:
            assert got[i].licence is None


@pytest.mark.parametrize("small", [licences.SMALL, 0])
def test_inheritance_and_awkward_rows(spark, small):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("/LICENSE", MIT_FILE), ("/a/b/COPYING", gpl), ("/a/b/c/x.py", "code"), ("/a/b/c/y.py", "# SPDX-License-Identifier: Apache-2.0\ncode"), ("/a/z.py", None),
        ("/ab/w.py", ""), ("v.py", "plain"), (None, "plain"), (None, "Released under the MIT License."), ("/a/b/notice.txt", "nothing here"), ("/a/b/LICENSE.md", ""), ("/a/b/c/x.py", "code"), ("/q/LICENSES/t.txt", "x " * 20000 + "\nReleased under the MIT License."),
        ("/two/LICENSE", gpl), ("/two/COPYING", "Licensed under CC BY 4.0."), ("/two/x.py", ""),
    ]
    df = licences.scan(spark.createDataFrame([(i, p, t, "x", 0.1) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, licence string, score double"), small=small)
    got = {r.doc_id: (r.licence, r.origin, r.from_dir) for r in df.collect()}
    assert got == {
        0: ("MIT", "file", None), 1: ("GPL-3.0", "file", None), 2: ("GPL-3.0", "inherited", "/a/b"), 3: ("Apache-2.0", "header", None), 4: ("MIT", "inherited", ""),
        5: ("MIT", "inherited", ""), 6: ("MIT", "inherited", ""), 7: (None, None, None), 8: ("MIT", "header", None), 9: ("GPL-3.0", "inherited", "/a/b"), 10: ("GPL-3.0", "inherited", "/a/b"), 11: ("GPL-3.0", "inherited", "/a/b"), 12: ("MIT", "header", None),
        13: ("GPL-3.0", "file", None), 14: ("CC-BY-4.0", "file", None), 15: ("CC-BY-4.0", "inherited", "/two"),  # equal scores: the smaller path
    }
    assert licences.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0
