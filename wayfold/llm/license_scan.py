"""Licence scans by sentence-rule recognition, with DataFrame functions only.

A text that has a licensing word is cut into sentences (comment marks off, wrapped lines joined), which are normalised to
lower-case words. A line is wrapped if the next one goes on in lower case or in brackets or quotes, if it ends with a comma or
with a word that needs another after it, or if both are in capitals; a semicolon ends a sentence unless the known notices go
on after it. A sentence that a pattern recognises becomes a sentence identifier; the identifiers, in the order of the
text, are matched against ordered licence rules, each a sequence of identifiers. A rule that matches takes its sentences out
of the sequence, so that a licence's full text is not also reported as its parts. Sentences with a licensing word that no
pattern knows are counted as unknown. There is no join and no exchange: a row needs nothing but itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of which a licensing sentence has at least one.
CUES = ["licens", "licenc", "copyright", "warrant", "redistribut", "permission", "spdx", "public domain", "liable", "rights reserved", "free software", "creative commons", "cc0", "cc by", "cc-by"]

# Sentence identifier, pattern of the whole normalised sentence.
_UNDER = "(?:this (?:work|file|software|program|project|code|document|library|content|text|material) is |it is )?(?:licensed|released|distributed|available|published|made available) under (?:the )?(?:terms of )?(?:the )?"
_GNU = "(?:as published by the free software foundation )?"
SENTENCES = [
    ("Copyright", "(?:portions )?(?:c )?copyright (?:c )?.*"),
    ("AllRights", "all rights reserved"),
    ("SpdxMit", "spdx license identifier mit(?: .*)?"),
    ("SpdxApache2", "spdx license identifier apache 2.0(?: .*)?"),
    ("SpdxBsd3", "spdx license identifier bsd 3 clause(?: .*)?"),
    ("SpdxBsd2", "spdx license identifier bsd 2 clause(?: .*)?"),
    ("SpdxIsc", "spdx license identifier isc(?: .*)?"),
    ("SpdxMpl2", "spdx license identifier mpl 2.0(?: .*)?"),
    ("SpdxGpl2Later", "spdx license identifier gpl 2.0(?: or later|\\+)(?: .*)?"),
    ("SpdxGpl2", "spdx license identifier gpl 2.0(?: only)?(?: .*)?"),
    ("SpdxGpl3Later", "spdx license identifier gpl 3.0(?: or later|\\+)(?: .*)?"),
    ("SpdxGpl3", "spdx license identifier gpl 3.0(?: only)?(?: .*)?"),
    ("UnderMit", _UNDER + "mit licen[sc]e(?: \\(?mit\\)?)?"),
    ("UnderApache2", _UNDER + "apache licen[sc]e(?: version)? 2.0(?: the license)?"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at(?: .*)?"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("UnderBsd3", _UNDER + "(?:new |revised |modified |3 clause )bsd(?: 3 clause)? licen[sc]e|" + _UNDER + "bsd 3 clause licen[sc]e"),
    ("UnderBsd2", _UNDER + "(?:simplified |2 clause )bsd licen[sc]e|" + _UNDER + "bsd 2 clause licen[sc]e"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "(?:1. )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "(?:2. )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdEndorse", "(?:3. )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("AsIs", "(?:this|the) software is provided .*as is.*"),
    ("Liable", "in no event shall .* be liable .*"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("MitNotice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("UnderIsc", _UNDER + "isc licen[sc]e"),
    ("UnderMpl2", _UNDER + "mozilla public licen[sc]e(?: v\\.?| version)? ?2.0|this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("UnderGpl2", _UNDER + "gnu general public licen[sc]e " + _GNU + "(?:v|version )2(?:.0)?(?: only)?"),
    ("UnderGpl2Later", _UNDER + "gnu general public licen[sc]e " + _GNU + "(?:v|version )2(?:.0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("UnderGpl3", _UNDER + "gnu general public licen[sc]e " + _GNU + "(?:v|version )3(?:.0)?(?: only)?"),
    ("UnderGpl3Later", _UNDER + "gnu general public licen[sc]e " + _GNU + "(?:v|version )3(?:.0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("UnderGpl", _UNDER + "gnu general public licen[sc]e"),
    ("GplFree2Later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GplFree3Later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplSee", "see the gnu general public license for more details"),
    ("GplCopy", "you should have received a copy of the gnu general public license along with this program(?:.*)?"),
    ("UnderLgpl21", _UNDER + "gnu (?:lesser|library) general public licen[sc]e (?:v|version )2.1(?: only)?"),
    ("UnderLgpl3", _UNDER + "gnu lesser general public licen[sc]e (?:v|version )3(?:.0)?(?: only)?"),
    ("UnderAgpl3", _UNDER + "gnu affero general public licen[sc]e (?:v|version )3(?:.0)?(?: only)?"),
    ("UnderCc0", _UNDER + "(?:creative commons (?:cc ?)?|cc ?)(?:0|zero)(?: 1.0)?(?: universal)?(?: licen[sc]e)?"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("PublicDomain", "this (?:work|file|software|program|code) is in the public domain"),
]
_CC = {"BY-NC-SA": "noncommercial sharealike", "BY-NC-ND": "noncommercial noderivatives", "BY-NC": "noncommercial", "BY-SA": "sharealike", "BY-ND": "noderivatives", "BY": ""}
for _kind, _words in _CC.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _long = f"creative commons attribution {_words}".strip() + f"(?: international)? {_version}(?: international)?"
        SENTENCES.append((f"UnderCc{_kind.replace('-', '')}{_version.replace('.', '')}", _UNDER + f"(?:a )?(?:cc {_kind.lower().replace('-', ' ')} {_version}|{_long})(?: licen[sc]e)?"))

# Licence, sequence of sentence identifiers. The first rule that fits takes its sentences.
RULES = [
    ("Apache-2.0", ["UnderApache2", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["UnderApache2", "ApacheUse", "ApacheCopy"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "AsIs", "Liable"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "AsIs", "Liable"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs", "Liable"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("ISC", ["IscGrant", "AsIs", "Liable"]),
    ("ISC", ["IscGrant"]),
    ("GPL-2.0-or-later", ["GplFree2Later", "GplHope", "GplSee", "GplCopy"]),
    ("GPL-3.0-or-later", ["GplFree3Later", "GplHope", "GplSee", "GplCopy"]),
    ("GPL-2.0-or-later", ["GplFree2Later"]),
    ("GPL-3.0-or-later", ["GplFree3Later"]),
    ("MIT", ["SpdxMit"]), ("Apache-2.0", ["SpdxApache2"]), ("BSD-3-Clause", ["SpdxBsd3"]), ("BSD-2-Clause", ["SpdxBsd2"]), ("ISC", ["SpdxIsc"]), ("MPL-2.0", ["SpdxMpl2"]),
    ("GPL-2.0-only", ["SpdxGpl2"]), ("GPL-2.0-or-later", ["SpdxGpl2Later"]), ("GPL-3.0-only", ["SpdxGpl3"]), ("GPL-3.0-or-later", ["SpdxGpl3Later"]),
    ("MIT", ["UnderMit"]), ("Apache-2.0", ["UnderApache2"]), ("BSD-3-Clause", ["UnderBsd3"]), ("BSD-2-Clause", ["UnderBsd2"]), ("ISC", ["UnderIsc"]), ("MPL-2.0", ["UnderMpl2"]),
    ("GPL-2.0-only", ["UnderGpl2"]), ("GPL-2.0-or-later", ["UnderGpl2Later"]), ("GPL-3.0-only", ["UnderGpl3"]), ("GPL-3.0-or-later", ["UnderGpl3Later"]), ("GPL", ["UnderGpl"]),
    ("LGPL-2.1-only", ["UnderLgpl21"]), ("LGPL-3.0-only", ["UnderLgpl3"]), ("AGPL-3.0-only", ["UnderAgpl3"]), ("CC0-1.0", ["UnderCc0"]),
    ("Unlicense", ["Unlicense"]), ("LicenseRef-public-domain", ["PublicDomain"]), ("LicenseRef-proprietary", ["Copyright", "AllRights"]), ("LicenseRef-proprietary", ["AllRights"]),
]
RULES += [(f"CC-{kind}-{version}", [f"UnderCc{kind.replace('-', '')}{version.replace('.', '')}"]) for kind in _CC for version in ("1.0", "2.0", "2.5", "3.0", "4.0")]

_GAP = "[ \\t\\r]*\\n[ \\t\\r]*"
#: (pattern, replacement with $1 and $2), one after the other: comment marks; the ways a line may be wrapped; sentence ends.
STEPS = [
    ("\\n[ \\t]*(?:/\\*+|#+|//+|\\*+|--+|;+)[ \\t]*", "\n"),
    (_GAP + "([a-z]|[(](?:at|the|and|or|including|if)[^a-z]|[\"\u201c][A-Za-z])", " $1"),
    ("(,|[ (](?:the|of|and|or|under|in|a|by|to|for|with|version|Version|GNU|Apache|MIT|BSD|ISC|Mozilla|Creative|Commons|CC|General|Public|Lesser|Library|Affero|Free|Software))" + _GAP + "([A-Z0-9])", "$1 $2"),
    ("([A-Z][A-Z][,;]?)" + _GAP + "([A-Z][A-Z])", "$1 $2"),
    (";[ \\t\\r\\n]+(you can|either|without)", " $1"),
    ("([.!?;])[ \\t\\n\\r\\f\\x0B]+", "$1\n"),
]


def _case(value: str, matches) -> str:
    return "CASE " + " ".join(f"WHEN {matches(value, '^(?:' + pattern.replace('.0', '[.]0').replace('.5', '[.]5').replace('.1', '[.]1') + ')$')} THEN '{name}'" for name, pattern in SENTENCES) + " END"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses, sentence_ids, n_unknown for every document; the names joined by commas.

    Licences are in the order of the rules, each once. Null and empty texts have empty strings and 0; repeated rows are
    scanned each; an empty table gives no rows; extra columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    plain = F.concat(F.lit("\n"), "text")
    for pattern, to in STEPS:
        plain = F.regexp_replace(plain, pattern, to)
    cut = F.when(_any(F.lower("text")), F.split(plain, "\n")).otherwise(F.array().cast("array<string>"))
    said = F.filter(cut, lambda x: _any(F.lower(x)))
    words = F.transform(said, lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9.+]+", " ")), "[. ]+$", ""))
    rows = rows.select("doc_id", words.alias("words"))
    escape = lambda p: p.replace("\\", "\\\\")
    ids = F.expr("transform(words, w -> coalesce(" + _case("w", lambda v, p: f"{v} rlike '{escape(p)}'") + ", ''))")
    rows = rows.select("doc_id", ids.alias("ids"))
    known = F.filter("ids", lambda x: x != "")
    rows = rows.select("doc_id", F.array_join(known, ",").alias("sentence_ids"), (F.size("ids") - F.size(known)).cast("long").alias("n_unknown"))
    found, left = [], F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(","))
    rows = rows.withColumn("left", left)
    for name, parts in RULES:
        run = "," + ",,".join(parts) + ","
        found.append(F.when(F.contains("left", F.lit(run)), F.lit(name)))
        # The chain is on one column: each rule sees what those before it have left.
        rows = rows.withColumn("got", F.array_append(F.col("got") if len(found) > 1 else F.array().cast("array<string>"), found[-1])).withColumn("left", F.replace("left", F.lit(run), F.lit(",;,")))
    return rows.select("doc_id", F.array_join(F.array_distinct(F.array_compact("got")), ",").alias("licenses"), "sentence_ids", "n_unknown")


def _any(column):
    test = F.lit(False)
    for c in CUES:
        test = test | F.contains(column, F.lit(c))
    return test


def oracle_sql() -> str:
    """The same rules as DuckDB SQL."""
    cue = lambda v: "(" + " OR ".join(f"contains({v}, '{c}')" for c in CUES) + ")"
    plain = "chr(10) || text"
    for pattern, to in STEPS:
        made = " || ".join("chr(10)" if x == "\n" else f"'{x}'" for x in re.split("(\n)", to.replace("$", "\\")) if x)
        plain = f"regexp_replace({plain}, '{pattern}', {made}, 'g')"
    steps = ["s0 AS (SELECT doc_id, sentence_ids, n_unknown, ',' || replace(sentence_ids, ',', ',,') || ',' AS l, CAST([] AS VARCHAR[]) AS got FROM k)"]
    for i, (name, parts) in enumerate(RULES):
        run = "," + ",,".join(parts) + ","
        steps.append(f"s{i + 1} AS (SELECT doc_id, sentence_ids, n_unknown, replace(l, '{run}', ',;,') AS l, CASE WHEN contains(l, '{run}') AND NOT list_contains(got, '{name}') THEN list_append(got, '{name}') ELSE got END AS got FROM s{i})")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, CASE WHEN {cue("lower(text)")} THEN string_split({plain}, chr(10)) ELSE [] END AS cut FROM t),
w AS (SELECT doc_id, list_transform(list_filter(cut, lambda x: {cue("lower(x)")}), lambda x: regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9.+]+', ' ', 'g')), '[. ]+$', '')) AS words FROM c),
i AS (SELECT doc_id, list_transform(words, lambda w: coalesce({_case("w", lambda v, p: f"regexp_matches({v}, '{p}')")}, '')) AS ids FROM w),
k AS (SELECT doc_id, coalesce(array_to_string(list_filter(ids, lambda x: x <> ''), ','), '') AS sentence_ids, len(list_filter(ids, lambda x: x = '')) AS n_unknown FROM i),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(got, ','), '') AS licenses, sentence_ids, n_unknown FROM s{len(RULES)}"""
