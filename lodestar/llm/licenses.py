"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form in which case, punctuation, white space,
how lines are broken, copyright lines and equivalent spellings make no difference;
its SHA-256 is joined to those of known licences.  A document is looked up as a
whole, which is what a licence scan is, and beyond that line by line, which finds
notices and SPDX lines inside other texts.

Nearly no text of a corpus is a licence.  Before a text or line is normalised, it has
to hold a row of STEMS, parts of words that no step of the normalisation makes
or breaks: what lacks them all can't become the form of a known text that has one.
The known texts are asked first; if one has no row of them, nothing is left out.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that only say whose copyright it is don't count (of a text in lower case; lines end in a line feed).
COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright *(\(c\)|©|[0-9])|\(c\) *[0-9]|©|all rights reserved).*$"
#: All but letters and digits separates words.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, after case and punctuation are gone: pattern and replacement, applied in turn to both sides.
SPELLINGS = (
    ("licenc", "licens"),
    ("(is|ys)(e|es|ed|ing|ation|ations) ", "z$2 "),
    ("iz(e|es|ed|ing|ation|ations) ", "z$1 "),
    ("(colo|favo|hono|labo|endeavo)ur", "$1r"),
    ("(acknowled|jud)gement", "$1gment"),
    ("(cance|labe|trave)ll(ed|ing)", "$1l$2"),
    ("fulfill", "fulfil"),
    ("willful", "wilful"),
    ("centre", "center"),
    ("artefact", "artifact"),
    ("programme ", "program "),
    (" (non|sub) ", " $1"),
    (" per cent ", " percent "),
    ("copyright owner", "copyright holder"),
    (" https ", " http "),
)
#: Parts of words that are in a text's canonical form only if they are in the text: what the spellings put in or join never spans one.
#: A text must have all of one row.
STEMS = (("licen",), ("permission",), ("software",), ("gpl",), ("under", "cc0"), ("under", "cc", "by", "4"), ("under", "creative"), ("under", "epl"), ("under", "mpl"), ("under", "clause"))
#: Known texts up to which their digests are sent to every task.
BROADCAST_ROWS = 100_000

#: Known licences and notices (fixed values).
KNOWN = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Whole texts as files, <licence>.txt, and how many lines with words in front are a text's own title.
TEXTS = Path(__file__).with_name("license_texts")
OWN_TITLE = {"Apache-2.0": 3, "Artistic-1.0-Perl": 1, "CC0-1.0": 2, "GFDL-1.2": 2, "GFDL-1.3": 2, "GPL-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-1.1": 2, "MPL-2.0": 1}
#: Names of licences, which stand over their texts and, but for bare identifiers, in notices.
NAMES = {
    "MIT": ("MIT License", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "Zero-Clause BSD", "0BSD License", "BSD 0-Clause License"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "GPL-1.0": ("GNU General Public License, version 1", "GNU General Public License v1.0", "GNU GPL v1"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPL version 2", "GPLv2", "GPL-2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPL version 3", "GPLv3", "GPL-3.0 License"),
    "LGPL-2.0": ("GNU Library General Public License, version 2", "GNU Library General Public License v2.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1 License"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL-3.0 License"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0 License"),
    "GFDL-1.2": ("GNU Free Documentation License, version 1.2", "GNU Free Documentation License v1.2"),
    "GFDL-1.3": ("GNU Free Documentation License, version 1.3", "GNU Free Documentation License v1.3"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0 License"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Artistic-1.0-Perl": ("Artistic License",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    **{f"CC-{x}-4.0": (f"CC {x} 4.0", f"CC {x} 4.0 License", f"Creative Commons {y} 4.0 International License") for x, y in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
#: What stands before a name in a notice of one line.
NOTICES = ("Licensed under", "Released under", "Distributed under", "Available under", "Published under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This code is licensed under", "This program is licensed under", "License:")
#: Identifiers of SPDX lines beside the names above; of GNU licences those with -only and -or-later.
SPDX = ("AFL-3.0", "Apache-1.1", "BSD-4-Clause", "BlueOak-1.0.0", "CC-BY-3.0", "CC-BY-SA-3.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EUPL-1.2", "MIT-0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11")


def _whole_texts(name: str, text: str) -> dict[str, str]:
    """A whole text under its own title (under each of its names, if it has none), without a title, and so without the instructions after its terms."""
    lines = text.splitlines()
    counted = [i for i, line in enumerate(lines) if re.search(r"\w", line)]
    body = "\n".join(lines[counted[OWN_TITLE.get(name, 0)] :])
    bodies = {"": body}
    terms = re.match(r"(?s).*END OF TERMS AND CONDITIONS", body)
    if terms:
        bodies["-terms"] = terms[0]
    if "[yyyy]" in body:  # a line that is filled in says whose copyright it is
        bodies["-filled"] = re.sub(r"(?m)^.*\[yyyy\].*$", "", body)
    own = ["\n".join(lines[: counted[OWN_TITLE[name]]])] if name in OWN_TITLE else []
    titles = own or [f"{the}{x}" for x in NAMES[name] for the in ("", "The ")]
    return {f"{name}{part}{f'-titled-{n}' if n else ''}": f"{title}\n{b}" if n else b for part, b in bodies.items() for n, title in enumerate(["", *titles])}


def _further() -> dict[str, str]:
    """Whole texts, notices and SPDX lines beside the values above; none of a canonical form that is there already, so far as words tell."""
    whole = {p.stem: p.read_text() for p in sorted(TEXTS.glob("*.txt"))} | {k: KNOWN[k] for k in ("MIT", "ISC", "0BSD", "Zlib")}
    found = {k: v for name, text in whole.items() for k, v in _whole_texts(name, text).items()}
    for name, names in NAMES.items():
        forms = [f"{before} {the}{x}" for before in NOTICES for x in names if x != name for the in ("", "the ")]
        found |= {f"{name}-notice-{n}": x for n, x in enumerate(forms, 1)}
    spdx = [*(x for x in NAMES if "GPL" not in x and "GFDL" not in x), *SPDX]
    spdx += [f"{x}{end}" for x in NAMES if "GPL" in x or "GFDL" in x for end in ("", "-only", "-or-later")]
    found |= {f"{x}-SPDX": f"SPDX-License-Identifier: {x}" for x in spdx}
    words = lambda x: " ".join(re.findall(r"\w+", x.lower().replace("licenc", "licens")))
    seen = {words(x): k for k, x in KNOWN.items()}
    return {k: x for k, x in found.items() if seen.setdefault(words(x), k) == k and k not in KNOWN}


KNOWN |= _further()


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, text) of the licences above, or of others."""
    rows = KNOWN if texts is None else texts
    return spark.createDataFrame(list(rows.items()), "license_id string, text string")


def canonical(low: Column) -> Column:
    """The canonical form of a text or line in lower case: its words between single spaces, without one at its ends; empty if nothing counts."""
    out = F.regexp_replace(F.regexp_replace(low, "(?md)" + COPYRIGHT, ""), BETWEEN, " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def _may_be_one(low: Column) -> Column:
    """Whether a text in lower case holds all of a row of STEMS."""
    return reduce(or_, (reduce(and_, (low.contains(s) for s in row)) for row in STEMS))


def scan(docs: DataFrame, licenses: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, license_id, whole_text, n_lines): the known licences that a document is, as a whole, or has as lines.

    whole_text says whether the whole text is the licence, n_lines counts the
    lines that are; a pair without either has no row.  Null, empty and blank
    texts, and texts without letters or digits, match nothing, nor do licences of
    that kind; rows that share an id (null included) are counted as one
    document; several licences of equal canonical form are all reported;
    further columns are ignored.  Nothing but matches is shuffled, up to
    BROADCAST_ROWS known texts; beyond, their digests are joined by a shuffle.
    """
    forms = licenses.select("license_id", canonical(F.lower("text")).alias("form")).where("form <> ''")
    rows, without = forms.agg(F.count("*"), F.count_if(~_may_be_one(F.col("form")))).first()  # the table of licences is small
    digests = forms.select("license_id", F.sha2("form", 256).alias("digest")).distinct()
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("low"))
    lines = F.split("low", "\n")
    if not without:
        own, lines = own.where(_may_be_one(F.col("low"))), F.filter(lines, _may_be_one)
    looked = F.concat(F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("low")).alias("form"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), canonical(x).alias("form"))))
    found = own.select("doc_id", F.inline(looked)).where("form <> ''").select("doc_id", "whole", F.sha2("form", 256).alias("digest"))
    found = found.join(F.broadcast(digests) if rows <= BROADCAST_ROWS else digests, "digest")
    return found.groupBy("doc_id", "license_id").agg(F.max("whole").alias("whole_text"), F.count_if(~F.col("whole")).alias("n_lines"))


def scan_sql() -> str:
    """What scan() is defined to give over documents and the licences above, for DuckDB: every text and every line is normalised."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        bare = f"regexp_replace(lower({x}), {quoted('(?m)' + COPYRIGHT)}, '', 'g')"
        out = f"(' ' || trim(regexp_replace({bare}, {quoted(BETWEEN)}, ' ', 'g')) || ' ')"
        for pattern, replacement in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(replacement.replace('$', chr(92)))}, 'g')"
        return f"trim({out})"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in KNOWN.items())
    return f"""
        WITH known(license_id, text) AS (VALUES {values}),
        forms AS (SELECT license_id, {form('text')} AS form FROM known),
        read AS (
            SELECT doc_id, TRUE AS whole, {form('text')} AS form FROM documents
            UNION ALL SELECT doc_id, FALSE, {form('line')} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
        SELECT doc_id, license_id, bool_or(whole) AS whole_text, count(*) FILTER (NOT whole) AS n_lines
        FROM read JOIN forms USING (form) WHERE form <> '' GROUP BY doc_id, license_id"""
