"""Operator 3: licence scan by canonical digest.

Whole texts are normalised (case, punctuation, copyright lines, equivalent spellings) and hashed; equal digests of known
licence texts and notices are found by a hash join.  A unit is a whole document or a run of its whole lines, so comment
marks before the lines, other line ends and lost paragraphs do not matter.  A run is hashed only where its first words begin a
known text and its number of words is that of the text: other runs have another digest anyway.  Texts are read once and
never shuffled; only digests are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import slices

# --- fixed values: equivalent spellings, each form and the one it is written as ---
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# --- fixed values: known texts and notices, by identifier ---
KNOWN = [
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "notice", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "notice", "Licensed under CC0 1.0."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("BSD-2-Clause", "notice", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, version 2.0."),
    ("proprietary", "notice", "All rights reserved."),
    ("MIT", "spdx", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "spdx", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "spdx", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "spdx", "SPDX-License-Identifier: MPL-2.0"),
    (
        "MIT",
        "text",
        "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person "
        "obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "text",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License.",
    ),
]

def full_texts() -> list[tuple[str, str, str]]:
    """The shipped licence texts (license_id, kind, text), each also without its first paragraph if that is a title."""
    texts = []
    for file in sorted(files("leafmill.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        name = file.name.removesuffix(".txt")
        for variant in (".bullets", ".regents"):
            name = name.removesuffix(variant)
        texts.append((name, "text", file.read_text()))
    texts += [k for k in KNOWN if k[1] == "text"]
    for name, kind, text in list(texts):
        title, _, rest = text.partition("\n\n")
        if len(title.split()) <= 20 and len(rest.split()) > 40:
            texts.append((name, kind, rest))
    return texts


#: First words by which runs are chosen for hashing.
KEY = 3
#: Bound of the table of known texts, whose first words and lengths go to every task.
MOST_TEXTS = 100_000

WORD = re.compile("[a-z0-9]+")
_SINGLE = {form: written for form, written in SPELLINGS if " " not in form}
_DOUBLE = {tuple(form.split()): written.split() for form, written in SPELLINGS if " " in form}
_PAIR_STARTS = {pair[0] for pair in _DOUBLE}

# a notice has a sign, a year or a place for one behind the word, or behind the sign
NOTICE = re.compile(r"[^a-z0-9\n(©]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]{4}|[<\[{]|$)|\(c\)[ \t]*(?:copyright\b|[0-9]{4}|[<\[{])|©)")
# a holder's line without these is one only if it is a paragraph of its own
HOLDER = re.compile(r"[^a-z0-9\n(©]*(?:copyright\b|\(c\))")
RESERVED = "all rights reserved"


def without_notices(low: str) -> str:
    """The lower-cased text with its copyright lines emptied, and "all rights reserved" right below one."""
    if not ("copyright" in low or "(c)" in low or "©" in low):
        return low
    lines = low.split("\n")
    blank = [not WORD.search(line) for line in lines]
    gone = False
    out = []
    for i, line in enumerate(lines):
        alone = (i == 0 or blank[i - 1]) and (i + 1 == len(lines) or blank[i + 1])
        below = gone and " ".join(WORD.findall(line)) == RESERVED
        gone = bool(NOTICE.match(line) or (alone and HOLDER.match(line)) or below)
        out.append("" if gone else line)
    return "\n".join(out)


def spelled(low: str, start: int = 0) -> Iterator[tuple[str, int]]:
    """The canonical words of a lower-cased text from ``start``, each with the end of the word in the text that it comes from."""
    waiting: tuple[str, int] | None = None
    for found in WORD.finditer(low, start):
        word, end = found.group(), found.end()
        if waiting:
            pair = _DOUBLE.get((waiting[0], word))
            if pair:
                waiting = None
                yield from ((w, end) for w in pair)
                continue
            yield from _spelled(*waiting)
            waiting = None
        if word in _PAIR_STARTS:
            waiting = (word, end)
        else:
            yield from _spelled(word, end)
    if waiting:
        yield from _spelled(*waiting)


def _spelled(word: str, end: int) -> Iterator[tuple[str, int]]:
    written = _SINGLE.get(word)
    if written is None:
        yield word, end
    else:
        yield from ((w, end) for w in written.split())


def canonical_words(text: str) -> list[str]:
    """Lower case, copyright lines gone, only runs of a-z and 0-9, equivalent spellings written one way."""
    return [w for w, _ in spelled(without_notices(text.lower()))]


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


class Beginnings:
    """First words of the known texts, and the lengths in words of those that begin with them."""

    def __init__(self, texts: list[str]):
        words = [w for w in map(canonical_words, texts) if w]
        self.size = min([KEY, *map(len, words)])
        self.lengths: dict[tuple, list[int]] = {}
        for w in words:
            self.lengths.setdefault(tuple(w[: self.size]), []).append(len(w))
        self.lengths = {k: sorted(set(v)) for k, v in self.lengths.items()}
        first = {w[0] for w in words}
        forms = first | {f for f, written in _SINGLE.items() if written.split()[0] in first}
        forms |= {pair[0] for pair, written in _DOUBLE.items() if written[0] in first}
        listed = "|".join(sorted(forms, key=lambda f: (-len(f), f))) or "(?!)"
        self.start = re.compile(rf"(?m)^[^a-z0-9\n]*({listed})(?![a-z0-9])")

    def runs(self, text: str) -> list[tuple]:
        """(unit, line_no, start, end, digest) of each run of whole lines that may be a known text.

        ``unit`` is document, line or block; a document of one line is both.  ``start`` and ``end`` are places in the text.
        """
        low = without_notices(text.lower())
        out, line, counted = [], 1, 0
        for found in self.start.finditer(low):
            start = found.start(1)
            words, ends = [], []
            lengths: list[int] | None = None
            for word, end in spelled(low, start):
                words.append(word)
                ends.append(end)
                if len(words) == self.size:
                    lengths = self.lengths.get(tuple(words))
                    if not lengths:
                        break
                if lengths and len(words) == lengths[-1]:
                    break
            for n in lengths or ():
                if n > len(words):
                    break
                stop = low.find("\n", ends[n - 1])
                stop = len(low) if stop < 0 else stop
                # the last word ends its line, and a word that stands for two is not cut
                if WORD.search(low, ends[n - 1], stop) or (n < len(ends) and ends[n] == ends[n - 1]):
                    continue
                line, counted = line + low.count("\n", counted, start), start
                made = digest(words[:n])
                one_line = low.find("\n", start, ends[n - 1]) < 0
                if one_line:
                    out.append(("line", line, start, ends[n - 1], made))
                if not WORD.search(low, 0, start) and not WORD.search(low, ends[n - 1]):
                    out.append(("document", None, start, ends[n - 1], made))
                elif not one_line:
                    out.append(("block", None, start, ends[n - 1], made))
        return out


def builtin_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + full_texts(), "license_id string, kind string, text string")


@lru_cache(4)
def _beginnings(texts: tuple[str, ...]) -> Beginnings:
    return Beginnings(list(texts))


FOUND = "doc_id long, row long, unit string, line_no int, start int, end int, digest string"


def license_scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, line_no, license_id, kind, digest): each whole document, whole line or run of whole lines that is a
    known text (license_id, kind, text), by default one of the built-in ones.

    ``unit`` is ``document``, ``line`` (``line_no`` counted from 1) or ``block`` (several lines of a longer document; line_no
    null).  A document of one line is matched as both; of a licence with and without its title the longer one is reported.
    Null and empty texts match nothing, repeated rows are reported each, other columns are left out, an empty table gives no
    rows.  One digest keeps its smallest (license_id, kind); a known text that is empty once normalised is left out.  The
    known texts are a reference list: more than ``MOST_TEXTS`` are an error.
    """
    spark = docs.sparkSession
    listed = (builtin_texts(spark) if texts is None else texts).select("license_id", "kind", "text").limit(MOST_TEXTS + 1).collect()
    if len(listed) > MOST_TEXTS:
        raise ValueError(f"more than {MOST_TEXTS} known texts")
    rows = [(r.license_id, r.kind, digest(w)) for r in listed if (w := canonical_words(r.text or ""))]
    known = (
        spark.createDataFrame(rows, "license_id string, kind string, digest string")
        .groupBy("digest")
        .agg(F.min(F.struct("license_id", "kind")).alias("first"))
        .select("digest", "first.license_id", "first.kind")
    )
    shipped = spark.sparkContext.broadcast(tuple(sorted({r.text for r in listed if r.text})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "unit", "line_no", "start", "end", "digest"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        beginnings = _beginnings(shipped.value)
        for batch in slices(batches, "text"):
            met = [
                (doc_id, row, *unit)
                for doc_id, row, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row", "text")), strict=True)
                if text
                for unit in beginnings.runs(text)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in met], k) for i, k in enumerate(kinds)], names)

    # a number of each row, since ids may repeat
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    found = read.mapInArrow(run, FOUND).join(known, "digest")
    line = F.col("unit") == "line"
    # of a text with and without its title, which end at one place, the longer one stays; lines are units of their own
    longest = found.groupBy("doc_id", "row", "license_id", "end", line.alias("line"), F.when(line, F.col("start")).alias("own")).agg(
        F.min(F.struct("start", "unit", "line_no", "kind", "digest")).alias("best")
    )
    return longest.select("doc_id", "best.unit", "best.line_no", "license_id", "best.kind", "best.digest")


def license_sql() -> str:
    """The same result as DuckDB SQL over ``documents``: lines as lists of words, runs of lines by list slices."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    values = ", ".join(
        f"({quoted(i)}, {quoted(k)}, {len(w)}, {quoted(w[0])}, {quoted(digest(w))})" for i, k, t in KNOWN + full_texts() if (w := canonical_words(t))
    )
    plain = "' ' || trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')) || ' '"
    for form, written in SPELLINGS:
        plain = f"replace({plain}, ' {form} ', ' {written} ')"
    sign = "[^a-z0-9(©]*"
    notice = rf"^{sign}(copyright[ \t:,]*(\(c\)|©|[0-9]{{4}}|[<\[{{]|$)|\(c\)[ \t]*(copyright\b|[0-9]{{4}}|[<\[{{])|©)"
    return rf"""
WITH known AS (
  SELECT digest, n, first, min((license_id, kind)) AS k FROM (VALUES {values}) t(license_id, kind, n, first, digest) GROUP BY ALL
),
lines AS (
  SELECT doc_id, id, i, low, NOT regexp_matches(low, '[a-z0-9]') AS blank, regexp_matches(low, '{notice}') AS notice,
         regexp_matches(low, '^{sign}(copyright\b|\(c\))') AS holder, trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')) = '{RESERVED}' AS reserved
  FROM (SELECT doc_id, id, generate_subscripts(ls, 1) AS i, unnest(ls) AS low
        FROM (SELECT doc_id, row_number() OVER () AS id, string_split(lower(text), chr(10)) AS ls FROM documents WHERE text <> ''))
),
marked AS (
  SELECT *, notice OR (holder AND lag(blank, 1, true) OVER w AND lead(blank, 1, true) OVER w) AS own FROM lines WINDOW w AS (PARTITION BY id ORDER BY i)
),
runs AS (SELECT *, count_if(NOT reserved OR own) OVER (PARTITION BY id ORDER BY i) AS run FROM marked),
gone AS (SELECT *, own OR (reserved AND bool_or(own) OVER (PARTITION BY id, run)) AS out FROM runs),
words AS (
  SELECT doc_id, id, i, list_filter(string_split({plain}, ' '), lambda w: w <> '') AS ws FROM gone WHERE NOT out AND NOT blank
),
placed AS (
  SELECT *, sum(len(ws)) OVER (PARTITION BY id ORDER BY i) AS stop FROM words WHERE len(ws) > 0
),
wholes AS MATERIALIZED (SELECT id, flatten(list(ws ORDER BY i)) AS all_words FROM placed GROUP BY id),
starts AS (SELECT doc_id, id, i, stop - len(ws) AS start, k.* FROM placed JOIN known k ON ws[1] = k.first),
hits AS (
  SELECT s.doc_id, s.id, s.i, s.start, e.i AS last, e.stop, s.digest, s.k, len(w.all_words) AS total
  FROM starts s JOIN placed e ON e.id = s.id AND e.stop = s.start + s.n JOIN wholes w ON w.id = s.id
  WHERE sha256(array_to_string(w.all_words[s.start + 1:s.start + s.n], ' ')) = s.digest
),
units AS (
  SELECT *, 'line' AS unit, CAST(i AS INTEGER) AS line_no FROM hits WHERE i = last
  UNION ALL SELECT *, 'document', NULL FROM hits WHERE start = 0 AND stop = total
  UNION ALL SELECT *, 'block', NULL FROM hits WHERE i <> last AND NOT (start = 0 AND stop = total)
)
SELECT doc_id, unit, line_no, k[1] AS license_id, k[2] AS kind, digest FROM units
QUALIFY unit = 'line' OR row_number() OVER (PARTITION BY id, k[1], stop, unit = 'line' ORDER BY start) = 1
"""
