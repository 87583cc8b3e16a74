"""License scans by Dice coefficient over word bigrams, in DataFrame functions only.

Units of a text are its lines, the sentences of lines with more than one, its
paragraphs, the whole text, and windows of words over all of these: wherever an anchor
bigram of a template stands, the run of as many words as the template has, laid so that the
anchor has its place in the template.  A license among other text, on part of a line or over
several paragraphs is found by its window.  Anchors are so many bigrams that every match
has at least one of them; all anchors of one copy ask for the same window, which is taken once.

A unit is lower-cased, cut into words of letters and
digits and turned into its set of word bigrams.  A template can only reach the threshold
t against sets of t / (2 - t) to (2 - t) / t times its own size; units outside the
bounds of all templates are dropped before their bigrams are listed, and the bounds
of each template hold in the join.  A match also shares t / (2 - t) of the template's
bigrams, so words that touch more than the rest of them are watched for: a text or unit
without any watched word cannot match and is not cut up further.  Templates are a fixed,
small table (broadcast); units meet a template only through a shared bigram.

Results: per document and license the best unit's Dice coefficient.  A license with
several templates counts once.  Defined results: null and empty texts match nothing; rows with
a null doc_id are scanned and reported together under a null doc_id; repeated rows
are reported once; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# fixed values: license texts and notices
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "This work is released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

# fixed values: English function words, watched for only where no other word is left
COMMON = frozenset("a an and any as at be by for from in into is it of on or that the this to under with you".split())


@dataclass(frozen=True)
class DiceScan:
    percent: int = 80


def _words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words):
    """Distinct bigrams of a list of words, the two joined by a blank."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def templates(spark: SparkSession, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """(template, license, words, bigrams, size)."""
    rows = [(k, name, text) for k, (name, text) in enumerate([*TEMPLATES, *extra])]
    return spark.createDataFrame(rows, "template int, license string, text string").select(
        "template", "license", _words(F.col("text")).alias("words"), _bigrams(_words(F.col("text"))).alias("bigrams")
    ).withColumn("size", F.size("bigrams"))


def watched_words(known: list, plan: DiceScan) -> list[str]:
    """Words of which every match of a template has at least one; rare words, which are long, first."""
    watched: set[str] = set()
    for r in known:
        needed = -(-r.size * plan.percent // (200 - plan.percent))  # bigrams that any match shares
        pairs = [set(b.split(" ")) for b in r.bigrams]
        for w in sorted(set().union(*pairs), key=lambda w: (w not in watched, w in COMMON, -len(w), w)):
            if sum(not pair & watched for pair in pairs) < needed:
                break
            watched.add(w)
    return sorted(watched)


def anchors(known: list, plan: DiceScan) -> dict[str, list[tuple[int, int, int]]]:
    """bigram: (template, place of the bigram in it, words of the template).

    Every match of a template has at least one of its anchors; those without function words and long ones first.
    """
    found: dict[str, list[tuple[int, int, int]]] = {}
    for r in known:
        needed = -(-r.size * plan.percent // (200 - plan.percent))
        order = sorted(r.bigrams, key=lambda b: (sum(w in COMMON for w in b.split(" ")), -len(b), b))
        chosen = set(order[: r.size - needed + 1])
        for k, pair in enumerate(zip(r.words, r.words[1:], strict=False)):
            if " ".join(pair) in chosen:
                found.setdefault(" ".join(pair), []).append((r.template, k, len(r.words)))
    return found


SHIFT = 1 << 32  # a window is the number template * SHIFT + its start + SHIFT / 2


def _windows(docs: DataFrame, marks: dict) -> DataFrame:
    """(doc_id, row, unit, w): each window that an anchor in ``words`` asks for, once."""
    if not marks:
        return docs.select("doc_id", "row", F.lit(0).cast("bigint").alias("unit"), F.col("words").alias("w")).where("false")
    lengths = F.create_map(*[F.lit(x) for t, n in sorted({(t, n) for places in marks.values() for t, _, n in places}) for x in (t, n)])
    codes = F.create_map(*[x for b, places in sorted(marks.items()) for x in (F.lit(b), F.array(*[F.lit(t * SHIFT + SHIFT // 2 - k) for t, k, _ in places]))])
    # what of the anchors the text has at all is found by hashing; only these are looked for place by place
    some = docs.withColumn("own", F.array_intersect(_bigrams(F.col("words")), F.array(*[F.lit(b) for b in sorted(marks)]))).where("size(own) > 0")
    pair = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.array_contains("own", pair(i)))
    asked = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.element_at(codes, pair(i)), lambda c: c + i))))

    def window(code):
        start = (F.pmod(code, F.lit(SHIFT)) - SHIFT // 2).cast("int")
        n = F.element_at(lengths, F.floor(code / SHIFT).cast("int"))
        return F.struct((-code - 1).alias("unit"), F.slice("words", F.greatest(start, F.lit(0)) + 1, n + F.least(start, F.lit(0))).alias("w"))

    return some.select("doc_id", "row", F.explode(F.transform(asked, window)).alias("x")).select("doc_id", "row", "x.unit", "x.w")


def scan(docs: DataFrame, known: DataFrame, plan: DiceScan = DiceScan()) -> DataFrame:
    """One row per document and license found: doc_id, license, dice."""
    p = plan.percent
    fits = f"n * {200 - p} >= size * {p} AND n * {p} <= size * {200 - p}"
    rows = known.where("size > 0").orderBy("template").collect()
    low = min((r.size for r in rows), default=0) * p
    high = max((r.size for r in rows), default=0) * (200 - p)
    watched = F.array(*[F.lit(w) for w in watched_words(rows, plan)]).cast("array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    sentences = F.flatten(F.transform(lines, lambda s: F.split(s, r"(?<=[.!?])[ \t]+")))
    units = F.array_distinct(F.concat(lines, sentences, F.split(text, r"\n[ \t]*\n"), F.array(text)))
    hopeful = docs.select("doc_id", "text").where(F.arrays_overlap(_words(text), watched)).withColumn("row", F.monotonically_increasing_id())
    each = hopeful.select("doc_id", "row", F.posexplode(units).alias("unit", "u"))
    each = each.select("doc_id", "row", F.col("unit").cast("bigint").alias("unit"), _words(F.col("u")).alias("w"))
    each = each.unionByName(_windows(hopeful.select("doc_id", "row", _words(text).alias("words")), anchors(rows, plan))).where(F.arrays_overlap("w", watched))
    # a unit has at least as many bigrams as distinct words, less one
    each = each.where((F.size(F.array_distinct("w")) - 1) * p <= high).select("doc_id", "row", "unit", _bigrams(F.col("w")).alias("b"))
    each = each.withColumn("n", F.size("b")).where((F.col("n") * (200 - p) >= low) & (F.col("n") * p <= high))
    listed = each.select("doc_id", "row", "unit", "n", F.explode("b").alias("bigram"))
    wanted = known.select("template", "license", "size", F.explode("bigrams").alias("bigram"))
    shared = (
        listed.join(F.broadcast(wanted), "bigram").where(fits)
        .groupBy("doc_id", "row", "unit", "n", "template", "license", "size").agg(F.count(F.lit(1)).alias("c"))
        .where(f"200 * c >= {p} * (n + size)")
    )
    return shared.groupBy("doc_id", "license").agg(F.max(F.round(2.0 * F.col("c") / (F.col("n") + F.col("size")), 6)).alias("dice"))


def oracle_sql(plan: DiceScan = DiceScan()) -> str:
    """The same rows in DuckDB's SQL, without size bounds."""
    known = []
    for k, (_, text) in enumerate(TEMPLATES):  # ASCII texts
        words_ = re.findall("[a-z0-9]+", text.lower())
        bigrams = list(dict.fromkeys(" ".join(x) for x in zip(words_, words_[1:], strict=False)))
        known.append(Row(template=k, words=words_, bigrams=bigrams, size=len(bigrams)))
    marks = ", ".join(f"('{b}', {t}, {k}, {n})" for b, places in anchors(known, plan).items() for t, k, n in places)
    quoted = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""WITH t AS (SELECT template, license, {pairs} AS b FROM (SELECT *, {words.format('text')} AS w FROM (VALUES {quoted}) v(template, license, text))),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS u FROM d),
units AS (SELECT * FROM lines UNION SELECT doc_id, r, unnest(regexp_split_to_array(u, '([.!?])[ \\t]+')) AS u FROM (SELECT doc_id, r, regexp_replace(u, '([.!?])[ \\t]+', '\\1' || chr(1) || '. ', 'g') AS u FROM lines)
  UNION SELECT doc_id, r, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) FROM d UNION SELECT doc_id, r, text FROM d),
a AS (SELECT * FROM (VALUES {marks}) v(g, template, k, m)), tw AS (SELECT doc_id, r, {words.format('text')} AS w FROM d),
places AS (SELECT doc_id, r, i - 1 AS i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, r, w, unnest(range(1, len(w))) AS i FROM tw)),
starts AS (SELECT DISTINCT r, i - k AS s, m FROM places JOIN a USING (g)),
windows AS (SELECT doc_id, r, w[greatest(s, 0) + 1 : s + m] AS w FROM starts JOIN tw USING (r)),
b AS (SELECT doc_id, r, u, {pairs} AS b FROM (SELECT doc_id, r, u, {words.format('u')} AS w FROM units)
  UNION ALL SELECT doc_id, r, array_to_string(w, ' ') AS u, {pairs} AS b FROM (SELECT DISTINCT * FROM windows)),
x AS (SELECT doc_id, r, u, len(b) AS n, unnest(b) AS g FROM (SELECT DISTINCT * FROM b)), y AS (SELECT template, license, len(b) AS m, unnest(b) AS g FROM t),
c AS (SELECT doc_id, r, u, n, template, license, m, count(*) AS c FROM x JOIN y USING (g) GROUP BY ALL)
SELECT doc_id, license, max(round(2.0::DOUBLE * c / (n + m), 6)) AS dice FROM c WHERE 200 * c >= {plan.percent} * (n + m) GROUP BY doc_id, license"""
