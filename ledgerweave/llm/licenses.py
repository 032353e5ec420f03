"""Licence scans by sentence rules.

A text is cut at sentence ends and line ends, the parts are normalised (lower
case, words only), and runs of parts that are a known licence sentence are
mapped to its identifier; the sequence of identifiers is matched against ordered
licence rules, the longer ones first.  A rule that matches takes its
identifiers, so that a shorter one does not match them again.  Parts that speak
of licensing without being known count as unmatched.

A known sentence begins and ends at a cut.  Inside it lines may break anywhere,
and comment signs are no words; an open end (a final ``.*``) runs on over line
ends and semicolons to the end of the sentence, a blank line or the next known
sentence, but those of ``BY_LINE`` end with their line.  ``ORACLE_SQL`` knows no
sentences over several parts: on texts without them it computes the same.

Only DataFrame functions.  Defined results: null text is the empty text and has
no sentences; A-Z alone are lowered, every other character that is no letter
a-z or digit separates words; identifiers stand in text order, licences in rule
order, each at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIGGER = "licen[sc]e|copyright|warrant|permission|redistribut|reserved"
#: Every known sentence holds one of these, as it stands in a lowered text or normalised, with L for a line's end.
TALK = TRIGGER + "|\\bcc[^a-z0-9]+(?:L )?by\\b|\\bcc0\\b|creative[^a-z0-9]+(?:L )?commons|public[^a-z0-9]+(?:L )?domain|under[^a-z0-9]+(?:L )?law\\b|no[^a-z0-9]+(?:L )?event\\b|\\bmpl\\b"
#: Identifier -> expression of the whole normalised sentence (fixed values, after the licences' own words).
SENTENCES = {
    "mit-title": "(the )?mit licen[sc]e( mit)?",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software .*",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind .*",
    "isc-title": "(the )?isc licen[sc]e( isc)?",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*",
    "isc-asis": "the software is provided as is and .* disclaims all warranties .*",
    "bsd-title": "(the )?((new |modified |revised |simplified )?bsd licen[sc]e|(bsd )?[23] clause( bsd)? licen[sc]e)",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",
    "bsd-source": "(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "(3 )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by .* as is and any express or implied warranties .*",
    "zlib-asis": "this software is provided as is without any express or implied warranty.*",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*",
    "liability": "in no event (shall|will) .* be (held )?liable .*",
    "apache-title": "apache license version 2 0( january 2004)?",
    "apache-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?apache (software )?license( version)? 2 0( the license)?",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at.*",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?mit licen[sc]e",
    "bsd-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?(new |simplified |[23] clause )?bsd licen[sc]e",
    "isc-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?isc licen[sc]e",
    "zlib-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?zlib licen[sc]e",
    "boost-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?boost software license( version)? 1 0.*",
    "boost-title": "boost software license version 1 0( august 17th 2003)?",
    "gpl3-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?gnu general public license( version)? (v )?3( 0)?",
    "gpl2-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?gnu general public license( version)? (v )?2( 0)?",
    "lgpl-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?gnu (lesser|library) general public license( version)?( (v )?[23]( [01])?)?",
    "agpl-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under the (terms of the )?gnu affero general public license( version)?( (v )?3( 0)?)?",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl-title": "gnu (lesser|library) general public license version (3 29 june 2007|2 1 february 1999|2 june 1991)",
    "agpl-title": "gnu affero general public license version 3 19 november 2007",
    "gpl3-terms": "(this (program|work|library|file) is free software you|you) can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 .*",
    "gpl2-terms": "(this (program|work|library|file) is free software you|you) can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 .*",
    "gpl-terms": "this (program|work|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation.*",
    "lgpl-terms": "this (program|work|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation.*",
    "agpl-terms": "this (program|work|library|file) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation.*",
    "gpl-hope": "this (program|work|library|file) is distributed in the hope that it will be useful but without any warranty.*",
    "gpl-details": "see the gnu (lesser |library |affero )?general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu (lesser |library |affero )?general public license along with this (program|work|library|file).*",
    "mpl-line": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at.*",
    "mpl-title": "mozilla public license version 2 0",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v( |ersion )?[12] 0.*",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0-waive": "to the extent possible under law .*waived all copyright .*",
    "cc0-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under (the )?(cc0|creative commons zero)( license)?( 1 0)?( universal)?( public domain dedication| license)?",
    "cc-by-nc-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under (the )?(cc by nc|creative commons attribution noncommercial)( license)?( [0-9]( [0-9])?)?( international)?( license)?",
    "cc-by-sa-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under (the )?(cc by sa|creative commons attribution sharealike)( license)?( [0-9]( [0-9])?)?( international)?( license)?",
    "cc-by-line": "((this|the) [a-z]+ is )?(released|licensed|distributed) under (the )?(cc by|creative commons attribution)( license)?( [0-9]( [0-9])?)?( international)?( license)?",
    "spdx-mit": "spdx license identifier mit",
    "spdx-isc": "spdx license identifier isc",
    "spdx-zlib": "spdx license identifier zlib",
    "spdx-boost": "spdx license identifier bsl 1 0",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-gpl2": "spdx license identifier gpl 2 0( only| or later)?",
    "spdx-gpl3": "spdx license identifier gpl 3 0( only| or later)?",
    "spdx-lgpl": "spdx license identifier lgpl [23] [01]( only| or later)?",
    "spdx-agpl": "spdx license identifier agpl 3 0( only| or later)?",
    "spdx-mpl": "spdx license identifier mpl 2 0",
    "spdx-epl": "spdx license identifier epl [12] 0",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-cc0": "spdx license identifier cc0 1 0",
    "spdx-cc-by": "spdx license identifier cc by [0-9] [0-9]",
    "spdx-cc-by-sa": "spdx license identifier cc by sa [0-9] [0-9]",
    "spdx-cc-by-nc": "spdx license identifier cc by nc [0-9] [0-9]",
    "spdx": "spdx license identifier .*",
    "reserved": "all rights reserved",
    "copyright": "copyright (c )?(19|20)[0-9][0-9].*",
}
#: Licence -> identifiers that must follow one another; the first rules are tried first.
RULES = [
    ("Apache-2.0", ("apache-line", "apache-comply", "apache-copy", "apache-asis", "apache-limits")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("Zlib", ("zlib-asis", "liability", "zlib-grant")),
    ("GPL-3.0", ("gpl3-terms", "gpl-hope")),
    ("GPL-2.0", ("gpl2-terms", "gpl-hope")),
    ("GPL", ("gpl-terms", "gpl-hope")),
    ("LGPL", ("lgpl-terms", "gpl-hope")),
    ("AGPL-3.0", ("agpl-terms", "gpl-hope")),
    ("ISC", ("isc-grant",)),
    *((name, (one,)) for name, ones in (
        ("Apache-2.0", ("apache-line", "apache-title", "spdx-apache")),
        ("MIT", ("mit-line", "mit-title", "spdx-mit")),
        ("BSD-3-Clause", ("spdx-bsd3",)),
        ("BSD-2-Clause", ("spdx-bsd2",)),
        ("BSD", ("bsd-line", "bsd-title")),
        ("ISC", ("isc-line", "isc-title", "spdx-isc")),
        ("Zlib", ("zlib-line", "spdx-zlib")),
        ("BSL-1.0", ("boost-line", "boost-title", "spdx-boost")),
        ("GPL-3.0", ("gpl3-line", "gpl3-title", "spdx-gpl3")),
        ("GPL-2.0", ("gpl2-line", "gpl2-title", "spdx-gpl2")),
        ("LGPL", ("lgpl-line", "lgpl-title", "spdx-lgpl")),
        ("AGPL-3.0", ("agpl-line", "agpl-title", "spdx-agpl")),
        ("MPL-2.0", ("mpl-line", "mpl-title", "spdx-mpl")),
        ("EPL", ("epl-terms", "spdx-epl")),
        ("Unlicense", ("unlicense", "spdx-unlicense")),
        ("CC0-1.0", ("cc0-line", "cc0-waive", "spdx-cc0")),
        ("CC-BY-NC", ("cc-by-nc-line", "spdx-cc-by-nc")),
        ("CC-BY-SA", ("cc-by-sa-line", "spdx-cc-by-sa")),
        ("CC-BY", ("cc-by-line", "spdx-cc-by")),
    ) for one in ones),
    ("Proprietary", ("reserved",)),
]
#: A licence that counts only where there is no other: many open licences say so beside the copyright.
ALONE = "Proprietary"

#: Cuts, as capitals that no lowered text holds: P blank line, D end of a sentence, S semicolon, L end of a line.  Of adjacent cuts the first of these stays.
CUTS = [
    ("\\r\\n?", "\n"),
    ("\\n[^a-z0-9\\n]*+\\n[^a-z0-9]*+", " P "),
    ("(?<![.!?])[.!?]++[ \\t\\n]++|:[ \\t]*+\\n", " D "),
    ("(?<!;);++[ \\t\\n]++", " S "),
    ("\\n", " L "),
    ("[^a-z0-9PDSL]+", " "),
    ("(?<![PDSL ])[DSL ]*+P[PDSL ]*+", " P "),
    ("(?<![DSL ])[SL ]*+D[DSL ]*+", " D "),
    ("(?<![SL ])[L ]*+S[SL ]*+", " S "),
    ("(?<![L ]) L[L ]*+", " L "),
]
#: Sentences whose open end is the rest of the line.
BY_LINE = ("spdx", "copyright", *(n for n in SENTENCES if n.startswith("spdx-")))
#: Cuts that stand in known sentences, besides line ends.
INNER = {"software you": "software (?:[LS] )?you", "foundation either": "foundation (?:[LS] )?either", "v 2": "v (?:[LD] )?2", "(v )?": "(v (?:[LD] )?)?", "at.*": "at(?: [PDSL])?(?: http [a-z0-9 ]*)?[a-z0-9 LS]*"}


def _over_lines(name: str, pattern: str) -> str:
    """The expression of a known sentence in a text with cuts."""
    for a, b in INNER.items():
        pattern = pattern.replace(a, b.replace(" ", "\0"))
    pattern = pattern.replace(" ", " (?:L )?").replace("\0", " ")
    if pattern.endswith(".*"):
        pattern = pattern[:-2] + ("[a-z0-9 ]*" if name in BY_LINE else "[a-z0-9 LS]*")
    return pattern.replace(".*", "[a-z0-9 LS]*?")


def _open(pattern: str) -> bool:
    return pattern.endswith(".*")


def _parts(low: Column) -> Column:
    """The parts of a lowered text; a known sentence is K and its name."""
    out = low
    for pattern, cut in CUTS:
        out = F.regexp_replace(out, pattern, cut)
    out = F.concat(F.lit("P "), F.trim(out), F.lit(" P"))
    heads = "|".join(f"{_over_lines(n, p[:-2])}" for n, p in SENTENCES.items() if _open(p))
    out = F.regexp_replace(out, f"[LS] (?={heads})", "D ")  # an open end does not run into the next known sentence
    for name in sorted(SENTENCES, key=lambda n: (n.endswith("-title"), _open(SENTENCES[n]))):  # a title may be the end of a sentence over two lines
        out = F.regexp_replace(out, f"([PDSL]) (?:{_over_lines(name, SENTENCES[name])})(?= [PDSL])", f"$1 K{name}")
    return F.transform(F.split(out, "[PDSL]"), lambda s: F.trim(s))


def _identifier(part: Column) -> Column:
    """The known sentence that it is; "?" for other talk of licences, else null."""
    return F.when(part.startswith("K"), F.substring(part, 2, 64)).when(part.rlike(TALK), "?")


def _after(n: int) -> str:
    """What the identifiers are once n rules were tried, as a column name."""
    return f"rest_{n}"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_licenses, n_unmatched) of every row."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("low"))
    found = F.filter(F.transform(_parts(F.col("low")), _identifier), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.when(F.col("low").rlike(TALK), found).otherwise(F.array().cast("array<string>")).alias("ids"))
    # each identifier stands between two commas; a taken one becomes #
    rows = rows.withColumn(_after(0), F.concat(F.lit(","), F.array_join(F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(","))), ""), F.lit(",")))
    for n, (_, sequence) in enumerate(RULES):
        rows = rows.withColumn(_after(n + 1), F.replace(F.col(_after(n)), F.lit("".join(f",{i}," for i in sequence)), F.lit(",#,")))
    names = list(dict.fromkeys(name for name, _ in RULES))
    hit = lambda name: F.when(sum((F.col(_after(n)) != F.col(_after(n + 1))).cast("int") for n, (x, _) in enumerate(RULES) if x == name) > 0, name)
    rows = rows.withColumn("every", F.array_compact(F.array(*map(hit, names))))
    rows = rows.withColumn("licenses", F.filter("every", lambda x: (x != ALONE) | (F.size("every") == 1)))
    return rows.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
        F.size(F.filter("ids", lambda x: x == "?")).cast("long").alias("n_unmatched"),
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_full_match(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES.items())
    brk = "[.!?;]+[ \\t\\r\\n]+|[\\r\\n]+"
    steps, last = [], "r0"
    for n, (_, sequence) in enumerate(RULES):
        steps.append(f"s{n + 1} AS (SELECT *, replace(rest_{n}, {quote(''.join(f',{i},' for i in sequence))}, ',#,') AS rest_{n + 1} FROM {'s' + str(n) if n else last})")
    names = list(dict.fromkeys(name for name, _ in RULES))
    hits = ", ".join("CASE WHEN " + " OR ".join(f"rest_{n} <> rest_{n + 1}" for n, (x, _) in enumerate(RULES) if x == name) + f" THEN {quote(name)} END" for name in names)
    return f"""
WITH low AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
cut AS (SELECT doc_id, CASE WHEN regexp_matches(low, {quote(TALK)}) THEN list_filter(list_transform(string_split_regex(low, {quote(brk)}), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: regexp_matches(x, {quote(TALK)})) ELSE [] END AS sentences FROM low),
r0 AS (SELECT doc_id, ids, ',' || array_to_string(list_transform(ids, lambda x: ',' || x || ','), '') || ',' AS rest_0 FROM (SELECT doc_id, list_transform(sentences, lambda s: CASE {cases} ELSE '?' END) AS ids FROM cut)),
{', '.join(steps)},
every AS (SELECT doc_id, ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM s{len(RULES)}),
named AS (SELECT doc_id, ids, list_filter(found, lambda x: x <> {quote(ALONE)} OR len(found) = 1) AS licenses FROM every)
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(licenses, ','), '') AS licenses, CAST(len(licenses) AS BIGINT) AS n_licenses, CAST(len(list_filter(ids, lambda x: x = '?')) AS BIGINT) AS n_unmatched FROM named
"""


ORACLE_SQL = _sql()


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
