"""Licence scans by canonical digest lookup (operator 4).

A text is brought to a canonical form: lower case, copyright statements away, equivalent spellings made one, and everything but letters
and digits one space. The digests of whole texts, of their paragraphs (parted by empty lines) and of their lines, so formed, are looked up
in a table of known licences by a hash join on the entire digest: no part of a text decides for the rest. The table holds whole licences, their
paragraphs where they are short, and usual notices; its size is a parameter's, not the data's, so that it is broadcast.

Every known form holds one of a few words, which are computed from the table (see sieve). A part of a text without any of them has another form,
whatever the rules for spellings do, and needs none: so most texts are only looked through once for these words.

A copyright statement is a line that begins with it, up to the line's end or to a sentence that begins with a word of NEXT.

Nulls: a null text matches nothing. A null or repeated doc_id is reported like others, once for all rows that have it. Texts without letters or digits have
an empty form, which no licence has. An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First words of a sentence that may follow a copyright statement on its line.
NEXT = r"licen[cs]ed|released|distributed|permission|redistribution|this"
#: Patterns on lower-case text, in this order, and what takes their place; Python and both engines read them alike.
LINES = [
    (rf"\. +({NEXT})\b", ".\n\\1"),
    (r"(?m)^[^a-z0-9\n©]*(copyright|©|\(c\)|portions copyright|all rights reserved)[^\n]*$", " "),
    (r"[^a-z0-9]+", " "),
]
SPELLINGS = [
    (r"\b(un|sub)?licenc(e|es|ed|ing|or|ors|ee|ees)\b", r"\1licens\2"),
    (r"\b(version|ver|v) ?([0-9]+)( 0)?\b", r"version \2"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bcreative commons attribution noncommercial\b", "cc by nc"),
    (r"\bcreative commons attribution\b", "cc by"),
    (r"\bgnu gpl\b", "gnu general public license"),
    (r"\bfavour(s|ed|able)?\b", r"favor\1"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bhttps\b", "http"),
]
#: What no rule above makes or takes away within a word: letters of a form that a text must have as they are.
_RULED = re.compile(r"licen[cs]|version|^ver$|^v[0-9]*$|commercial|creative|commons|attribution|^cc|^by$|^nc$|gnu|gpl|general|public|favou?r|merchant|https?|copyright|reserved|portions|[0-9]")

NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "Distributed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Released under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Licensed under Creative Commons Attribution-NonCommercial 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""

TEXTS = {
    "MIT": [_MIT_BODY, f"MIT License\n\n{_MIT_BODY}", f"The MIT License (MIT)\n\n{_MIT_BODY}", *_MIT_BODY.split("\n\n")],
    "ISC": [_ISC_BODY, f"ISC License\n\n{_ISC_BODY}", *_ISC_BODY.split("\n\n")],
    "BSD-2-Clause": [f"{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}", _BSD_3],
    "GPL-3.0": [_GPL3_HEADER],
}


#: SHA-256 of the canonical forms of whole licences, as their publishers print them: fixed values, made by form() from the texts that Debian's base-files
#: package has in /usr/share/common-licenses. Apache-2.0 is there twice, with and without its appendix.
WHOLE = {
    "Apache-2.0": ("505d0bcde4b3f1e36672aeef5d9e1204a43221f11d0db61c257049dabfb786be", "383108d907616895332d8117617a0f6912e2d7006251811eb3470d0bdbc31391",),
    "Artistic-1.0-Perl": ("93aa47d57763801ed6e6a6591d4d4049a2c46794df90838023ceade56b569da0",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",),
    "GFDL-1.3": ("b27b2c4bcb2f657f6b8fe90a1378a84d2d3ce131583c2feb506a434db1437681",),
    "GPL-1.0": ("9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",),
    "GPL-2.0": ("b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",),
    "GPL-3.0": ("901462947b625293d41f5decfe7d7e3e70f2f51e95bb496859faefee2d6fcf79",),
    "LGPL-2.0": ("b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c",),
    "LGPL-2.1": ("294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e",),
    "LGPL-3.0": ("af4f466bab5554afad60c219ff8bf29eddb00df6ef0f1fcf73fa05ad4b3289f5",),
    "MPL-1.1": ("fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",),
    "MPL-2.0": ("f5d70dcb3be1b6a5c30cd39f304e1d869cb80654c2970e51a714e33dc73f006a",),
}
#: Words that every one of these whole texts has.
WHOLE_HAVE = "licen"


def form(text: str) -> str:
    """The canonical form of a text, as canonical() makes it."""
    out = text.lower()
    for pattern, put in LINES + SPELLINGS:
        out = re.sub(pattern, put, out)
    return out.strip(" ")


def known() -> list[tuple[str, str]]:
    """Licence and text of all entries of which the table has the text."""
    return [(name, text) for table in (NOTICES, TEXTS) for name, texts in table.items() for text in texts]


def digests(entries: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Licence and digest of all entries; without entries, of the known texts and whole licences."""
    made = {(name, hashlib.sha256(form(text).encode()).hexdigest()) for name, text in entries or known()}
    return sorted(made if entries else made | {(name, digest) for name, of in WHOLE.items() for digest in of})


def sieve(entries: list[tuple[str, str]] | None = None) -> list[str]:
    """Strings of which every text whose form is an entry's has one, in lower case; few, and rare where there is a choice.

    `licen` stands for all spellings of licence. Entries without it give a long word that no rule touches."""
    words = [{("licen" if "licens" in w else w) for w in form(text).split() if "licens" in w or (len(w) > 4 and not _RULED.search(w))} for _, text in entries or known()]
    if any(not w for w in words):
        raise ValueError("an entry has no word to look for")
    chosen = [WHOLE_HAVE] if not entries or any("licen" in w for w in words) else []
    rest = [w for w in words if not w & set(chosen)]
    while rest:
        best = max(set().union(*rest), key=lambda x: (sum(x in w for w in rest), len(x), x))
        chosen.append(best)
        rest = [w for w in rest if best not in w]
    return chosen


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.lower(text)
    for pattern, put in LINES + SPELLINGS:
        out = F.regexp_replace(out, pattern, re.sub(r"\\([0-9])", r"$\1", put))
    return F.trim(out)


def licence_table(spark: SparkSession, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """license and digest of the entries' canonical forms."""
    return spark.createDataFrame(digests(entries), "license string, digest string")


def scan(docs: DataFrame, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, n_text, n_paragraphs, n_lines: how often each part of a document is, whole, a known licence or notice.

    Parts of a document with the same digest count each; a line that is a paragraph or a text of its own counts as each. entries: other licences (name, text) than the known."""
    text, looked_for = F.col("text"), sieve(entries)

    def may(part: Column) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(F.lower(part), F.lit(w)) for w in looked_for))

    def named(scope: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, may), lambda x: F.struct(F.lit(scope).alias("scope"), x.alias("part")))

    parts = F.concat(named("text", F.array(text)), named("paragraph", F.split(text, r"\n[ \t\r]*\n\s*")), named("line", F.split(text, "\n")))
    rows = docs.where(text.isNotNull() & may(text)).select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.scope", F.sha2(canonical(F.col("p.part")), 256).alias("digest"))
    hits = rows.join(F.broadcast(licence_table(docs.sparkSession, entries)), "digest")
    return hits.groupBy("doc_id", "license").agg(*(F.count_if(F.col("scope") == s).alias(n) for s, n in (("text", "n_text"), ("paragraph", "n_paragraphs"), ("line", "n_lines"))))


def _duck(text: str) -> str:
    out = f"lower({text})"
    for pattern, put in LINES + SPELLINGS:
        if "\n" in put:  # a line feed has no escape in a replacement
            put = "' || chr(10) || '".join(put.split("\n"))
            out = f"regexp_replace({out}, '{pattern}', ('{put}'), 'g')"
        else:
            out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return f"sha256(trim({out}, ' '))"


def scan_sql() -> str:
    """The scan in DuckDB's SQL, without the sieve."""
    values = ",\n".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known())
    whole = ", ".join(f"('{name}', '{digest}')" for name, of in WHOLE.items() for digest in of)
    return f"""
WITH known(license, body) AS (VALUES {values}),
whole(license, digest) AS (VALUES {whole}),
licences AS (SELECT license, {_duck("body")} AS digest FROM known UNION SELECT license, digest FROM whole),
parts AS (
  SELECT doc_id, 'text' AS scope, text AS part FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'paragraph', unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*')) FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL
),
digests AS (SELECT doc_id, scope, {_duck("part")} AS digest FROM parts)
SELECT doc_id, license, count(*) FILTER (scope = 'text') AS n_text, count(*) FILTER (scope = 'paragraph') AS n_paragraphs, count(*) FILTER (scope = 'line') AS n_lines
FROM digests JOIN licences USING (digest) GROUP BY doc_id, license
"""
