"""Cases in which an operator once did less than the whole job."""

import random
import re
import textwrap
import time
from re import _constants, _parser

import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import fingerprints, langid, licenses, pii, secrets

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
BSD2 = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
BSD3 = BSD2.replace("distribution.\n\n", "distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n")
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed with this file, You can obtain one at http://mozilla.org/."
WHOLE = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-3.0": GPL3, "GPL-2.0": GPL2, "ISC": ISC, "Apache-2.0": APACHE, "MPL-2.0": MPL}


LGPL = GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
MORE = {
    "LGPL": LGPL,
    "AGPL-3.0": AGPL,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file.)",
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which is available elsewhere.",
    "MIT": "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + MIT + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",
    "BSD-3-Clause": "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n" + BSD3,
    "Apache-2.0": "Copyright 2018 Jane Doe\n\n" + APACHE,
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies of this document.",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Preamble",
    "LGPL ": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nPreamble",
    "ISC": ISC + '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.',
    "MPL-2.0": MPL,
}
SPDX = {
    "MIT": "MIT", "ISC": "ISC", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1-or-later": "LGPL", "AGPL-3.0": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY", "CC-BY-SA-4.0": "CC-BY-SA", "CC-BY-NC-4.0": "CC-BY-NC", "Foo-1.0": "",
}


def test_more_licenses(spark):
    laid = lambda text, prefix: "\n".join(prefix + x for line in text.split("\n") for x in (textwrap.wrap(line, 76) or [""]))
    texts = [f(x) for x in MORE.values() for f in (str, lambda x: laid(x, ""), lambda x: laid(x, " * "))]
    got = scanned(spark, texts)
    for k, name in enumerate(n for n in MORE for _ in range(3)):
        assert got[k]["licenses"] == name.strip(), (name, k % 3, got[k], texts[k])


def test_spdx_lines(spark):
    got = scanned(spark, [f"{c} SPDX-License-Identifier: {x}\nint main;" for x in SPDX for c in ("//", "#", "/*")])
    assert [got[k]["licenses"] for k in range(3 * len(SPDX))] == [n for n in SPDX.values() for _ in range(3)]
    assert scanned(spark, ["All rights reserved.", "The MIT License\nAll rights reserved."])[1]["licenses"] == "MIT"


def scanned(spark, texts):
    return {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("prefix, end", [(None, "\n"), ("", "\n"), ("", "\r\n"), (" * ", "\n"), ("# ", "\n"), ("// ", "\n")])
def test_wrapped_licenses(spark, prefix, end):
    def laid(text):
        lines = text.split("\n") if prefix is None else [prefix + x for line in text.split("\n") for x in (textwrap.wrap(line, 76) or [""])]
        return end.join(lines)

    got = scanned(spark, map(laid, WHOLE.values()))
    for k, name in enumerate(WHOLE):
        assert (got[k]["licenses"], got[k]["n_unmatched"]) == (name.strip(), 0), (name, got[k])
    assert got[6]["sentence_ids"] == "apache-line,apache-comply,apache-copy,apache-asis,apache-limits"


def test_open_ends_stop_at_known_sentences(spark):
    got = scanned(spark, ["Copyright (c) 2020 Foo\n" + MIT.replace("\n\n", "\n").replace(":\nThe", "\nThe").replace(".\nTHE", "\nTHE"), "Released under the\nMIT license\nAll rights reserved\nA licence of\nour own", "; " * 100000 + "licence" + "\n" * 100000])
    assert got[0]["sentence_ids"] == "copyright,mit-grant,mit-notice,mit-asis"
    assert got[1]["sentence_ids"] == "mit-line,reserved,?" and got[2]["sentence_ids"] == "?"


def shortest(items):
    """A shortest string that a parsed expression matches."""
    out = ""
    for op, value in items:
        if op is _constants.LITERAL:
            out += chr(value)
        elif op is _constants.IN:
            out += chr(value[0][1][0] if value[0][0] is _constants.RANGE else value[0][1])
        elif op is _constants.ANY:
            out += "x"
        elif op is _constants.SUBPATTERN:
            out += shortest(value[3])
        elif op is _constants.BRANCH:
            out += min(map(shortest, value[1]), key=len)
        else:
            assert op is _constants.MAX_REPEAT, op
            out += shortest(value[2]) * value[0]
    return out


def test_every_known_sentence_is_looked_at(spark):
    least = {name: shortest(_parser.parse(pattern.replace(" .*", " x").replace(".*", ""))) for name, pattern in licenses.SENTENCES.items()}
    assert [n for n, s in least.items() if not re.search(licenses.TALK, s)] == []
    texts = [*least.values(), *(s.replace(" ", "\n") for s in least.values())]
    found = scanned(spark, texts)
    for k, name in enumerate([*least, *least]):
        if k >= len(least) and name in licenses.BY_LINE:
            continue  # ends with its line
        assert found[k]["sentence_ids"] == name, (name, texts[k], found[k])


def test_creative_commons(spark):
    got = scanned(spark, ["Released under CC BY 4.0.", "Distributed under CC BY-SA 4.0.", "Released under Creative Commons\nAttribution 4.0 International.", "Some words on creative commons.", "released under pressure"])
    assert [(got[k]["licenses"], got[k]["n_unmatched"]) for k in range(5)] == [("CC-BY", 0), ("CC-BY-SA", 0), ("CC-BY", 0), ("", 1), ("", 0)]


def test_junk_is_no_language(spark):
    import corpus_pipeline as cp

    rng = random.Random(8)
    make = {"aa": "etaoinshr", "bb": "äöüßgkzwe", "cc": "éèêçoiuae"}
    words = {x: ["".join(rng.choice(s) for _ in range(rng.randint(2, 8))) for _ in range(150)] for x, s in make.items()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(8, 60))), x) for i, x in enumerate(rng.choice(list(make)) for _ in range(300))]
    say = lambda signs, n, gap="": gap.join("".join(rng.choice(signs) for _ in range(7)) for _ in range(n))
    span = lambda a, b: [chr(c) for c in range(a, b)]
    junk = [say(langid.SIGNS[0], 40) for _ in range(20)] + [say(span(0x410, 0x450), 30, " ") for _ in range(20)] + [say(span(0x4E00, 0x9000), 20) for _ in range(20)] + [say(langid.SIGNS[2], 30, " ") for _ in range(20)]
    docs = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in cp.language_id(spark, docs, "").collect()}
    assert len(kept & set(range(300))) >= 297 and len(kept - set(range(300))) <= 1
    assert cp.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect() == []


def test_redaction_takes_whole_keys(spark):
    rng = random.Random(9)
    sign = langid.SIGNS[0]
    lines = ["".join(rng.choice(sign) for _ in range(64)) for _ in range(25)] + ["".join(rng.choice(sign) for _ in range(11)) + "="]
    begin, end, fields = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
    bodies = {"\n": lines, "\r\n": lines, " ": lines, "\\n": lines, "\n# ": lines, '\\n" +\n  "': lines, "\n ": [*fields, *lines]}
    rows, whole = [], [False, True]
    for gap, body in bodies.items():
        rows += ["é before " + gap.join([begin, *body, *([end] * w)]) + "\n\nafter it. " for w in whole]
    rows += [f"a {begin} b", f"{begin}\n{lines[0]}\n{begin}\n{lines[1]}\n{end} c", f"{begin}\n" + "\n".join(lines[:25] * 40) + f"\n{end} d", f"{begin} x " * 3000]
    got = [r[1] for r in secrets.redact(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    n = 2 * len(bodies)
    for k, text in enumerate(got[:n]):
        assert text.startswith("é before [SECRET]") and text.endswith("after it. ") and "PRIVATE" not in text and not any(x[:8] in text for x in lines), (k, text)
    assert got[n:] == ["a [SECRET] b", "[SECRET]\n[SECRET] c", "[SECRET] d", "[SECRET] x " * 3000]


def test_iban_before_other_words(spark):
    ibans = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "BE68 5390 0754 7034"]
    rows = [f"IBAN {i}{after}" for i in ibans for after in (" BIC COBADEFFXXX", " EUR 500", " 2024", ", BIC", "", " 12 34")] + ["IBAN DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "DE89370400440532013001 EUR", "DE893704004405320130001"]
    got = {r["doc_id"]: [x["m"] for x in r["iban"]] for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for k in range(6 * len(ibans)):
        assert got[k] == [ibans[k // 6]], rows[k]
    assert [got[k] for k in range(6 * len(ibans), len(rows))] == [ibans[:2], [], []]


def test_fingerprints_of_many_chunks(spark):
    n = (1 << 20) + 5
    docs = spark.createDataFrame([(1, n), (2, n), (3, 5)], "doc_id long, n int").withColumn("text", F.expr("repeat(doc_id % 2 || ',', n)")).repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, ["doc_id"]).collect()}
    assert all(got[k]["n"] == n and set(got[k]["sketch"]) == {0, n} for k in (1, 2))
    alike = lambda a, b: sum((2 * x - a["n"]) * (2 * y - b["n"]) for x, y in zip(a["sketch"], b["sketch"])) / (120 * a["n"] * b["n"])
    assert alike(got[1], got[3]) == 1 and abs(alike(got[1], got[2])) < 0.5


@pytest.mark.parametrize("lines", [100, 450, 2000, 40000])
def test_private_keys_of_any_length(lines):
    """Header to END goes, with lines that are no base64 among the others; text around it stays."""
    body = "\n".join("!not base64 - at all!" if k % 3 == 1 else "QUJD" * 16 for k in range(lines))
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    text = f"before {key} between -----BEGIN PRIVATE KEY-----\n{'QUJD' * 10}\nno end -----BEGIN CERTIFICATE----- after {key} last"
    spans = [(a, b) for kind, a, b in secrets._scanner(True).scan([text.encode()])[0] if kind == "private_key"]
    left = "".join(text[a:b] for a, b in zip([0] + [b for _, b in spans], [a for a, _ in spans] + [len(text)]))
    assert left.startswith("before  between ") and left.endswith(" after  last") and "QUJD" not in left and "not base64" not in left


def test_private_key_headers_alone_are_read_in_linear_time():
    text = b"-----BEGIN PRIVATE KEY----- - x " * 60000
    begin = time.process_time()
    secrets._scanner(True).scan([text])
    assert time.process_time() - begin < 20


def test_pipeline_on_edge_rows(spark):
    """Nulls, equal and empty texts, a long one, clashing columns and an empty table, stage by stage."""
    import corpus_pipeline as cp

    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(40) for _ in range(60)]
    rows = [(i, t, "en", len(t)) for i, t in enumerate(texts)] + [(None, say(30), "en", 1), (100, None, "en", 0), (101, "", None, 0), (102, " 12 ", "en", 4), (103, texts[5], "en", 9), (5, texts[5], "en", 9), (104, say(60000), "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("n", "sig", "component_id", "found", "length", "bucket", "rid", "node", "score")})
    stage = dict(cp.STAGES)
    known = stage["language_id"](spark, docs, "")
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == {*range(60), None, 103, 104}
    one = stage["near_duplicates"](spark, known, "")
    assert one.columns == docs.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in one.collect()) == sorted([*range(60), -1, 104])
    clean = stage["secret_scan"](spark, one, "")
    assert clean.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    packed = stage["best_fit_packing"](spark, clean, "").collect()
    assert {r["doc_id"] for r in packed} == {*range(60), None, 104} and all(r["length"] <= 2048 for r in packed)
    rows = docs.limit(0)
    for name, f in cp.STAGES:
        rows = f(spark, rows, "")
        assert rows.collect() == [], name
