"""Licence recognition by sentence identifiers and ordered rules, in Spark SQL only.

Comment marks and list numbers at the beginning of lines are taken off, and each text is cut into
sentences twice: at sentence marks and blank lines, where a single line end is a blank
(wrapped licence texts), and at sentence marks and every line end (notices of one
line without a mark).  Sentences are normalised (A-Z lower-cased, everything but
letters and digits a blank), and the known ones become identifiers.  A licence is
recognised where the identifiers of one of its rules occur in their order in either
sequence; other sentences, known or not, may stand between them.  A licence whose
sentences are all found in a longer one (BSD-2 in BSD-3) gives way to it.  There is
no shuffle: every row is handled on its own, whole, by built-in functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The licences' rules, each a sequence of known sentences.
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
        'Software is furnished to do so')
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met")
_BSD_SOURCE = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
               "disclaimer")
_BSD_BINARY = ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
               "disclaimer in the documentation and/or other materials provided with the distribution")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
TEXTS = [
    ("mit", (_MIT + ", subject to the following conditions", _MIT_NOTICE)),
    ("mit", ("Released under the MIT License",)),
    ("mit", ("Licensed under the MIT License",)),
    ("mit", ("This project is licensed under the MIT License",)),
    ("mit", ("Distributed under the MIT License",)),
    ("mit-0", (_MIT, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
               'THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT')),
    ("x11", (_MIT_NOTICE, "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise "
             "to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium")),
    ("isc", (_ISC + ", provided that the above copyright notice and this permission notice appear in all copies",)),
    ("isc", (_ISC.replace("and/or", "and") + ", provided that the above copyright notice and this permission notice appear in all copies",)),
    ("isc", ("Licensed under the ISC License",)),
    ("0bsd", (_ISC,)),
    ("bsd-2-clause", (_BSD, _BSD_SOURCE, _BSD_BINARY)),
    ("bsd-2-clause", ("Licensed under the BSD 2-Clause License",)),
    ("bsd-3-clause", (_BSD, _BSD_SOURCE, _BSD_BINARY, "Neither the name of the copyright holder nor the names of its contributors may be "
                      "used to endorse or promote products derived from this software without specific prior written permission")),
    ("bsd-3-clause", (_BSD, _BSD_SOURCE, _BSD_BINARY, "Neither the name of the University nor the names of its contributors may be "
                      "used to endorse or promote products derived from this software without specific prior written permission")),
    ("bsd-3-clause", ("Licensed under the BSD 3-Clause License",)),
    ("bsd-3-clause", ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",)),
    ("bsd-4-clause", (_BSD, _BSD_SOURCE, _BSD_BINARY, "All advertising materials mentioning features or use of this software must display "
                      "the following acknowledgement")),
    ("apache-2.0", ("Licensed under the Apache License, Version 2.0",)),
    ("apache-2.0", ('Licensed under the Apache License, Version 2.0 (the "License")',
                    "you may not use this file except in compliance with the License")),
    ("apache-2.0", ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",)),
    ("apache-1.1", (_BSD, _BSD_SOURCE, _BSD_BINARY, "The end-user documentation included with the redistribution, if any, must include the "
                    "following acknowledgment")),
    ("gpl-3.0", ("This work is licensed under the GNU General Public License, version 3",)),
    ("gpl-2.0", ("This program is free software", "you can redistribute it and/or modify it under the terms of the GNU General Public "
                 "License version 2 as published by the Free Software Foundation")),
    ("gpl-2.0", ("This work is licensed under the GNU General Public License, version 2",)),
    ("mpl-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v",
                 "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/")),
    ("mpl-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v",
                 "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/")),
    ("mpl-1.1", ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',
                 "you may not use this file except in compliance with the License")),
    ("epl-1.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
                 "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",)),
    ("epl-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
                 "is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("cddl-1.0", ('The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
                  "You may not use this file except in compliance with the License")),
    ("unlicense", ("This is free and unencumbered software released into the public domain",
                   "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
                   "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means")),
    ("cc0-1.0", ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
                 "software to the public domain worldwide", "This software is distributed without any warranty")),
    ("cc0-1.0", ("Licensed under CC0 1.0",)),
    ("wtfpl", ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
               "allowed as long as the name is changed",)),
    ("zlib", ("This software is provided 'as-is', without any express or implied warranty",
              "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
              "and redistribute it freely, subject to the following restrictions")),
    ("bsl-1.0", ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and '
                 'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
                 'transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software '
                 'is furnished to do so, all subject to the following',)),
    ("bsl-1.0", ("Distributed under the Boost Software License, Version 1.0",)),
    ("postgresql", ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and "
                    "without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the "
                    "following two paragraphs appear in all copies",)),
    ("ofl-1.1", ("This Font Software is licensed under the SIL Open Font License, Version 1.1",)),
    ("ncsa", ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
              'files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, '
              'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
              'Software is furnished to do so, subject to the following conditions',)),
    ("ms-pl", ("This license governs use of the accompanying software",
               "If you use the software, you accept this license")),
    ("artistic-2.0", ("Licensed under the Artistic License 2.0",)),
    ("eupl-1.2", ("Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions "
                  'of the EUPL (the "Licence")',)),
    ("afl-3.0", ("Licensed under the Academic Free License version 3.0",)),
    ("gfdl-1.3", ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
                  "License, Version 1.3 or any later version published by the Free Software Foundation",)),
    ("odbl-1.0", ("This database is made available under the Open Database License",)),
    ("odbl-1.0", ("This data is made available under the Open Database License",)),
]
# Licence names with their kind of work, full name and versions, for the notices that differ in these alone.
GNU = [("gpl", "program", "General Public", "2 3"), ("lgpl", "library", "Lesser General Public", "2.1 3"), ("lgpl", "program", "Lesser General Public", "2.1 3"),
       ("agpl", "program", "Affero General Public", "3")]
CREATIVE = [("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")]
# A licence that is left out where one of the others is found, as their texts hold its sentences.
WITHIN = {"bsd-2-clause": ("bsd-3-clause", "bsd-4-clause", "apache-1.1"), "mit": ("x11",), "mit-0": ("mit", "x11"), "0bsd": ("isc",)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPDX = r"spdx-license-identifier:[ \t]*([a-z0-9.+-]+)"
PREFIX = r"(^|\n)[ \t]*(?://+|/[*]+|[*]+/?|#+|;+|--+|<!--)+[ \t]*"
NUMBER = r"(^|\n)[ \t]*(?:[(]?[0-9]{1,2}[.)]|[(]?[a-z][.)]|[-+•])[ \t]+"
WRAPPED = r"[.!?;:]+[ \t\n]+|\n[ \t]*\n[ \t\n]*"
SINGLE = r"[.!?;:]+[ \t\n]+|\n+"


def normalised(sentence: str) -> str:
    """The normal form on the driver, for the table of known sentences."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """All rules: licence and the normal forms of its sentences in order."""
    out = [(name, tuple(map(normalised, texts))) for name, texts in TEXTS]
    for short, work, full, versions in GNU:
        terms = f"you can redistribute it and/or modify it under the terms of the GNU {full} License as published by the Free Software Foundation"
        for v in versions.split():
            name, later = f"{short}-{v if '.' in v else v + '.0'}", f"either version {v} of the License, or (at your option) any later version"
            first = normalised(f"This {work} is free software")
            out += [(name, (first, normalised(f"{terms}, {later}"))), (name, (first, normalised(terms), normalised(later)))]
    for short, full in CREATIVE:
        for v, kind in (("4.0", "International"), ("3.0", "Unported")):
            out += [(f"cc-{short}-{v}", (normalised(x),)) for x in (
                f"Licensed under CC {short} {v}", f"This work is licensed under CC {short} {v}",
                f"This work is licensed under a Creative Commons {full} {v} {kind} License",
                f"This work is licensed under the Creative Commons {full} {v} {kind} License")]
    for name in sorted({n for n, _ in out}):
        gnu = name.split("-")[0] in ("gpl", "lgpl", "agpl", "gfdl")
        out += [(name, (normalised(f"SPDX-License-Identifier {name}{end}"),)) for end in (("", "-only", "-or-later", "+") if gnu else ("",))]
    return list(dict.fromkeys(out))


def known_sentences() -> dict[str, int]:
    """Normal form to identifier, numbered as they first come in the rules."""
    out: dict[str, int] = {}
    for _, texts in rules():
        for t in texts:
            out.setdefault(t, len(out) + 1)
    return out


def patterns() -> dict[str, str]:
    """Per licence, a regular expression of its rules over a path ``,id,id,...,``."""
    known = known_sentences()
    out: dict[str, list[str]] = {}
    for name, texts in rules():
        out.setdefault(name, []).append("," + ",(?:.*,)?".join(str(known[t]) for t in texts) + ",")
    return {name: "|".join(dict.fromkeys(found)) for name, found in sorted(out.items())}


def prepared(text: Column) -> Column:
    """Lower case, line ends as \\n, SPDX tags as paragraphs, without comment marks and list numbers before lines."""
    low = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\r\n?", "\n")
    low = F.regexp_replace(low, SPDX, "\n\nspdx-license-identifier $1\n\n")
    return F.regexp_replace(F.regexp_replace(low, PREFIX, "$1"), NUMBER, "$1")


def identifiers(low: Column, border: str) -> Column:
    """Array of the identifiers of the known sentences, in text order."""
    table = F.create_map(*(F.lit(x) for item in known_sentences().items() for x in item))
    plain = F.transform(F.split(low, border), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(F.transform(plain, lambda s: F.element_at(table, s)), lambda i: i.isNotNull())


def recognise(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, licenses)`` per row of ``docs(doc_id, text)``.

    ``n_sentences`` counts known licence sentences, by the cut that finds more;
    ``licenses`` is the sorted, comma-joined list of recognised licences, empty
    without one.  A null or empty text has none, a text of any length is read
    whole; rows are independent, repeated rows are returned as often as they come,
    other columns are ignored, an empty table gives an empty result.
    """
    low = docs.select("doc_id", prepared(F.col("text")).alias("low"))
    found = low.select("doc_id", identifiers(F.col("low"), WRAPPED).alias("a"), identifiers(F.col("low"), SINGLE).alias("b"))
    path = lambda c: F.concat(F.lit(","), F.array_join(F.transform(c, lambda i: i.cast("string")), ","), F.lit(","))
    found = found.select("doc_id", F.greatest(F.size("a"), F.size("b")).cast("long").alias("n_sentences"),
                         F.concat(path("a"), F.lit("\n"), path("b")).alias("path"))
    hits = F.filter(F.array(*[F.when(F.rlike("path", F.lit(p)), F.lit(name)) for name, p in patterns().items()]), lambda x: x.isNotNull())
    found = found.select("doc_id", "n_sentences", F.when(F.col("n_sentences") > 0, hits).otherwise(F.array().cast("array<string>")).alias("hits"))
    outer = F.create_map(*(F.lit(x) for name, over in WITHIN.items() for x in (name, ",".join(over))))
    left = F.filter("hits", lambda x: ~F.coalesce(F.arrays_overlap(F.split(F.element_at(outer, x), ","), F.col("hits")), F.lit(False)))
    return found.select("doc_id", "n_sentences", F.array_join(left, ",").alias("licenses"))


def oracle() -> str:
    """The same result in DuckDB SQL, from the same tables of sentences and rules."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    keys, values = ", ".join(map(q, known)), ", ".join(map(str, known.values()))
    hits = ", ".join(f"CASE WHEN regexp_matches(path, {q(p)}) THEN {q(name)} END" for name, p in patterns().items())
    outer = ", ".join(q(n) for n in WITHIN)
    over = ", ".join("[" + ", ".join(map(q, v)) + "]" for v in WITHIN.values())
    ids = lambda border: (f"list_filter(list_transform(string_split_regex(t, {q(border)}), lambda s: map_extract_value(MAP([{keys}], [{values}]), "  # noqa: E731
                          "trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')))), lambda i: i IS NOT NULL)")
    return f"""
WITH low AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '\\r\\n?', chr(10), 'g') AS t FROM documents),
tagged AS (SELECT doc_id, regexp_replace(t, {q(SPDX)}, chr(10) || chr(10) || 'spdx-license-identifier \\1' || chr(10) || chr(10), 'g') AS t FROM low),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(t, {q(PREFIX)}, '\\1', 'g'), {q(NUMBER)}, '\\1', 'g') AS t FROM tagged),
ids AS (SELECT doc_id, {ids(WRAPPED)} AS a, {ids(SINGLE)} AS b FROM bare),
seq AS (SELECT doc_id, greatest(len(a), len(b)) AS n, ',' || array_to_string(a, ',') || ',' || chr(10) || ',' || array_to_string(b, ',') || ',' AS path
        FROM ids),
hit AS (SELECT doc_id, n, CASE WHEN n > 0 THEN list_filter([{hits}], lambda x: x IS NOT NULL) ELSE [] END AS hits FROM seq)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, array_to_string(list_filter(hits, lambda x: NOT coalesce(
           list_has_any(map_extract_value(MAP([{outer}], [{over}]), x), hits), false)), ',') AS licenses FROM hit"""
