"""License notices in documents, with DataFrame functions only (operator 7).

Words are runs of a-z and 0-9 of the lower-cased text, shingles five of them.
Templates fall into size classes c, powers of two; a class looks at windows of
2c shingles that start every c, so that each occurrence lies inside a window.
Windows without any shingle of a template of their class can't match and aren't
opened.
Windows are retrieved by ``BANDS`` one-row MinHash bands: a template contained
to 0.8 has a similarity to its window of at least 0.19, so a band agrees with
that probability and all fail with (1 - 0.19)**64 < 2e-6. Retrieved templates are
confirmed by exact containment of their shingles in the window.

Defined results: null texts, and those of fewer than five words, hold nothing;
very long texts are scanned whole, in time linear in their length; a license
found in several windows gives one row with the best containment and, on a tie,
the first such window; rows that repeat a doc_id count as one document. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS, CONTAINED, WORDS = 64, 0.8, 5

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'

#: Notices, headers and whole license bodies, of 5 to some 220 words.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": _BSD_HEAD,
    "BSD-2-Clause-body": f"{_BSD_HEAD}: {_BSD_TWO} {_BSD_TAIL}",
    "BSD-3-Clause-body": f"{_BSD_HEAD}: {_BSD_TWO} {_BSD_THREE} {_BSD_TAIL}",
    "BSL-1.0-body": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-body": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": "Released under the MIT License.",
    "MIT-body": f"{_MIT_GRANT} {_AS_IS}",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _once(value: Column) -> Column:
    """One row with the value: a generator, into which later lambdas can't inline (and repeat) its making."""
    return F.explode(F.array(value))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """A hash for each place from which five words follow."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))


def _bands(window: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(window, lambda h: F.xxhash64(h, b))))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license_id, its distinct shingles and its size class."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in sorted(texts.items())]))
    t = spark.range(1).select(rows.alias("t")).select("t.license_id", _words(F.col("t.text")).alias("w")).where(F.size("w") >= WORDS)
    t = t.select("license_id", _once(F.array_distinct(_shingles(F.col("w")))).alias("set"))
    return t.withColumn("c", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("set")))).cast("int"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license_id, containment and first_shingle (of the window) of each license in docs(doc_id, text)."""
    spark = docs.sparkSession
    t = templates(spark, texts or TEMPLATES)
    known = t.select("license_id", "c", "set").collect()  # the templates are constants
    every = sorted({h for r in known for h in r["set"]})
    classes = sorted({r.c for r in known})
    words = docs.where("text is not null").select("doc_id", _once(_words(F.col("text"))).alias("w")).where(F.size("w") >= WORDS)
    marked = words.select("doc_id", _once(_shingles(F.col("w"))).alias("s"))
    hits = F.filter(F.transform("s", lambda h, i: F.when(h.isin(every), i)), lambda i: i.isNotNull())
    marked = marked.select("doc_id", "s", _once(hits).alias("hits")).where(F.size("hits") > 0)
    # all windows of a size are cut inside one expression, so that a row with its text's shingles isn't copied for each
    opened = None
    for c in classes:
        own = sorted({h for r in known if r.c == c for h in r["set"]})
        mine = F.filter("hits", lambda i: F.get("s", i).isin(own))
        places = F.array_distinct(F.flatten(F.transform(mine, lambda i: F.array(F.floor(i / c).cast("int") - 1, F.floor(i / c).cast("int")))))
        windows = F.transform(F.filter(places, lambda k: k >= 0), lambda k: F.struct((k * c).alias("first"), F.slice("s", k * c + 1, 2 * c).alias("window")))
        windows = F.transform(windows, lambda x: F.struct(F.lit(c).alias("c"), x["first"].alias("first"), x["window"].alias("window")))
        opened = windows if opened is None else F.concat(opened, windows)
    opened = marked.select("doc_id", F.explode(opened).alias("w")).select("doc_id", "w.c", F.col("w.first").alias("first_shingle"), F.col("w.window").alias("window"))
    banded = opened.select("*", F.posexplode(_bands(F.col("window"))).alias("band", "value"))
    own = t.select("license_id", "c", F.col("set"), F.posexplode(_bands(F.col("set"))).alias("band", "value"))
    found = banded.join(F.broadcast(own), ["c", "band", "value"]).select("doc_id", "license_id", "first_shingle", (F.size(F.array_intersect("window", "set")) / F.size("set")).alias("containment"))
    found = found.where(F.col("containment") >= CONTAINED)
    best = found.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", -F.col("first_shingle"))).alias("m"))
    return best.select("doc_id", "license_id", F.round("m.containment", 6).alias("containment"), (-F.col("m.col2")).cast("long").alias("first_shingle"))


def scan_sql(texts: dict[str, str] | None = None) -> str:
    """The same rows in DuckDB's SQL, without windows that hold no shingle and without bands."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((texts or TEMPLATES).items()))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT license_id, {words.format("text")} AS w FROM (VALUES {rows}) v(license_id, text)),
ts AS (SELECT DISTINCT license_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT license_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
tn AS (SELECT license_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS c FROM ts GROUP BY license_id),
d AS (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT s.doc_id, ts.license_id, s.g, tn.n, tn.c, s.p // tn.c AS k FROM s JOIN ts ON ts.g = s.g JOIN tn ON tn.license_id = ts.license_id),
x AS (SELECT doc_id, license_id, g, n, c, k FROM h UNION ALL SELECT doc_id, license_id, g, n, c, k - 1 FROM h WHERE k > 0),
m AS (SELECT doc_id, license_id, k * c AS first_shingle, count(DISTINCT g) / n AS containment FROM x GROUP BY doc_id, license_id, k, c, n)
SELECT doc_id, license_id, round(containment, 6) AS containment, CAST(first_shingle AS BIGINT) AS first_shingle FROM m WHERE containment >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, license_id ORDER BY containment DESC, first_shingle) = 1
"""
