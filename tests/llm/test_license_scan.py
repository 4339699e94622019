import random
import re

import pytest

from tests.llm.helpers import edge_docs, edge_rows, no_docs, prose
from wayfold.llm.license_scan import CUES, RULES, SENTENCES, scan

MIT = """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal in the Software.
// The above copyright notice and this permission notice shall be included in all
// copies or substantial portions of the Software.
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""

GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

APACHE = """   Copyright 2020 A Person

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""

BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES."""

CASES = [
    ("Words.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.\nMore", "GPL-3.0-only"),
    ("x. Licensed under CC BY-NC 4.0. y", "CC-BY-NC-4.0"),
    ("Released under the MIT License.", "MIT"),
    (MIT, "MIT"),
    ("# SPDX-License-Identifier: BSD-3-Clause\ncode", "BSD-3-Clause"),
    ("Copyright (c) 2020 A. Person\nAll rights reserved.", "LicenseRef-proprietary"),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ("Licensed under the GNU General Public License version 2 or (at your option) any later version.", "GPL-2.0-or-later"),
    ("no words of that kind", ""),
    ("Released under CC0.", "CC0-1.0"),
    ("It is available under CC BY-SA 4.0. Words", "CC-BY-SA-4.0"),
    ("Available under CC BY-SA 4.0. Words", "CC-BY-SA-4.0"),
    ("Distributed under Creative Commons Attribution 4.0.", "CC-BY-4.0"),
    ("Heading\nLicensed under the Apache\nLicense, Version 2.0.\nMore words", "Apache-2.0"),
    ("Licensed under the MIT License; see the file", "MIT"),
    (GPL.format(2), "GPL-2.0-or-later"),
    (GPL.format(3), "GPL-3.0-or-later"),
    (" * " + GPL.format(3).replace("\n", "\n * "), "GPL-3.0-or-later"),
    (APACHE, "Apache-2.0"),
    (BSD3, "BSD-3-Clause"),
]


def test_cases(spark):
    rows = {r.doc_id: r for r in scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert set(rows[i].licenses.split(",")) == set(want.split(",")), text
    assert rows[4].sentence_ids == "MitGrant,MitNotice,AsIs"


def test_canonical_notices_are_whole(spark):
    texts = [(0, GPL.format(2)), (1, APACHE), (2, BSD3)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[0].sentence_ids == "GplFree2Later,GplHope,GplSee,GplCopy"
    assert got[1].sentence_ids.split(",")[-5:] == ["UnderApache2", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]
    assert got[2].sentence_ids == "BsdGrant,BsdSource,BsdBinary,BsdEndorse,AsIs,Liable"


def by_hand(sentences):
    """Identifiers and licences of sentences that stand on lines of their own: every rule tried at every place, in order."""
    known = [(n, re.compile(p.replace(".0", "[.]0").replace(".5", "[.]5").replace(".1", "[.]1"))) for n, p in SENTENCES]
    ids, unknown = [], 0
    for x in sentences:
        if any(c in x.lower() for c in CUES):
            plain = " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789.+" else " " for c in x.lower()).split()).rstrip(". ")
            name = next((n for n, p in known if p.fullmatch(plain)), None)
            ids, unknown = ids + [name] if name else ids, unknown + (name is None)
    left, found = list(ids), []
    for licence, rule in RULES:
        k = 0
        while k + len(rule) <= len(left):
            if left[k : k + len(rule)] == rule:
                found += [licence] if licence not in found else []
                left[k : k + len(rule)] = [None]
            k += 1
    return ",".join(found), ",".join(ids), unknown


def test_against_rules_by_hand(spark):
    r = random.Random(5)
    said = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License.", "You may obtain a copy of the License at x.", "Copyright (c) 2001 Someone.", "All rights reserved.", "SPDX-License-Identifier: ISC.", "This is a licence to nothing.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.", "The software is provided as is.", "In no event shall they be liable for it.", "Plain words.", "Published under CC BY-NC 4.0."]
    texts = [[r.choice(said) for _ in range(r.randint(0, 12))] for _ in range(60)]
    got = {x.doc_id: x for x in scan(spark.createDataFrame([(i, "\n\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].licenses, got[i].sentence_ids, got[i].n_unknown) == by_hand(t), t


def test_a_very_long_text(spark):
    text = "\n\n".join(prose(i, 40) + "\n\nReleased under the MIT License.\nThis licence is unlike others." for i in range(3000))
    r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licenses == "MIT" and r.sentence_ids == ",".join(["UnderMit"] * 3000) and r.n_unknown == 3000


def test_unknown_sentences_are_counted(spark):
    r = scan(spark.createDataFrame([(1, "You need a permission slip. Fine.")], "doc_id long, text string")).first()
    assert (r.licenses, r.sentence_ids, r.n_unknown) == ("", "", 1)


def test_edges(spark):
    rows = scan(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows()) and all(r.licenses == "" for r in rows)
    assert scan(no_docs(spark)).count() == 0


def test_only_spark_s_own_functions_run(spark):
    plan = scan(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("text", ["\n", "licensed", "copyright " * 2000])
def test_odd_texts(spark, text):
    assert scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
