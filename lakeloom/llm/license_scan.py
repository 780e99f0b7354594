"""License scans by diagonal voting.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
All rolling word ``K``-gram hashes of every document are joined with the
positions of the same hashes in the templates (a fixed list, broadcast). A match
at word p of the document and word t of a template votes for the diagonal p - t,
where the template would start.

* A base phrase stands at p exactly when all of its grams vote for diagonal p.
* For longer templates neighbouring diagonals are merged into a span: inserted or
  missing words move the diagonal, by at most a fourth of the template's length (or
  ``LEAST_SHIFT``) at a time. A span with enough votes for the score is verified by the
  longest chain of matches that rises in both document and template; its share of the
  template's grams is the score, and ``MIN_SCORE`` gives the label. No vote is dropped
  before the merge.

The templates are the paragraphs of the short public licenses in full and the notices
that the long ones ask for.

Defined results: null and empty texts have no words, no labels and score 0; rows
sharing an id are separate rows of the result; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged
from .registry import query, table
from .textbytes import ALNUM, LOWER, gram_hashes, text_slices, word_hashes, words

K = 2
LEAST_SHIFT = 8
MIN_SCORE = 0.7

#: Phrase -> label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions"""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""

#: Passages of public licenses, in the order (label, passage).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", _GRANT),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License"""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"""),
    ("gpl", """You should have received a copy of the GNU General Public License along with this program. If not, see"""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution"""),
    ("bsd", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission"""),
    ("bsd", _BSD_DISCLAIMER),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies"""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means"""),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

SENTINEL = 0  # a gram that every document holds, so that none is lost in the join


def _hashes(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(np.array([0, len(data)]), data, ALNUM)
    return word_hashes(data, starts, ends)


def template_rows(base: dict[str, str], templates) -> list[tuple[int, int, int]]:
    """(hash, template number, position): base phrases first, sentinel number -1."""
    out = [(SENTINEL, -1, 0)]
    for no, text in enumerate([*base, *(t for _, t in templates)]):
        h = _hashes(text)
        if len(h) < K:
            raise ValueError(f"template has fewer than {K} words: {text!r}")
        grams, _, at = gram_hashes(h, np.array([0, len(h)]), K)
        out += [(int(g), no, int(p)) for g, p in zip(grams.view(np.int64), at)]
    return out


def gram_batches(batches):
    for batch in batches:
        n_words, lengths, parts = [], [], []
        for _, off, data in text_slices(batch.column("text")):
            low = LOWER[data]
            starts, ends, first = words(off, low, ALNUM)
            g, gram_first, _ = gram_hashes(word_hashes(low, starts, ends), first, K)
            count = np.diff(gram_first)
            n_words.append(np.diff(first))
            lengths.append(count + 1)
            parts.append(np.insert(g.view(np.int64), gram_first[1:], SENTINEL))  # last in each text
        if not n_words:
            continue
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("id"), pa.array(np.concatenate(n_words)),
             pa.ListArray.from_arrays(offsets, np.concatenate(parts))], names=["rid", "id", "n_words", "grams"])


def chain_length(pairs) -> int:
    """Longest chain of (document, template) positions rising in both."""
    tails: list[int] = []
    for _, t in sorted(pairs, key=lambda x: (x[0], -x[1])):
        at = bisect.bisect_left(tails, t)
        tails[at:at + 1] = [t]
    return len(tails)


def verify_batches(batches):
    for batch in batches:
        got = []
        for diagonals, positions in zip(batch.column("diagonals").to_pylist(), batch.column("positions").to_pylist()):
            got.append(chain_length([(d + p, p) for d, ps in zip(diagonals, positions) for p in ps]))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("template"), batch.column("first"),
                                          pa.array(got, pa.int64())], names=["rid", "template", "first", "chain"])


def scan_licenses(docs: DataFrame, base=None, templates=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans). ``documents``: rid, id, n_words, n_base, first_word,
    last_word, base_labels, labels, score. ``spans``: rid, label, first (word
    where the template starts on the span's strongest diagonal), score, for every verified place."""
    spark = docs.sparkSession
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    rows = template_rows(base, templates)
    names = [*base.values(), *(name for name, _ in templates)]
    grams = [sum(1 for r in rows if r[1] == no) for no in range(len(names))]
    known = spark.createDataFrame(rows, "gram long, template int, t int")  # a few hundred rows, fixed
    facts = spark.createDataFrame([(no, names[no], grams[no], no < len(base)) for no in range(len(names))],
                                  "template int, label string, grams int, is_base boolean")

    keep = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).alias("text"))
    rolling = keep.mapInArrow(gram_batches, "rid long, id long, n_words long, grams array<long>")
    votes = (rolling.select("rid", "id", "n_words", F.posexplode("grams").alias("p", "gram"))
             .join(F.broadcast(known), "gram")
             .groupBy("rid", "id", "n_words", "template", (F.col("p") - F.col("t")).cast("long").alias("diagonal"))
             .agg(F.sort_array(F.collect_set("t")).alias("positions")))
    votes = staged(votes, "votes")

    hits = votes.join(F.broadcast(facts), "template")
    exact = hits.where("is_base and size(positions) = grams").select(
        "rid", "label", F.col("diagonal").alias("first"), F.lit(1.0).alias("score"), "is_base")
    # All diagonals are merged; a span can reach the score only with as many votes, and a
    # document's template only with as many in all.
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    enough = F.col("grams") * MIN_SCORE - 1e-9
    near = (hits.where("not is_base")
            .withColumn("all", F.sum(F.size("positions")).over(Window.partitionBy("rid", "template"))).where(F.col("all") >= enough)
            .withColumn("cut", (F.col("diagonal") - F.lag("diagonal").over(order)
                                > F.greatest(F.lit(LEAST_SHIFT), F.floor(F.col("grams") / 4))).cast("int"))
            .withColumn("span", F.sum(F.coalesce("cut", F.lit(0))).over(order))
            .groupBy("rid", "template", "span", "grams")
            .agg(F.max_by("diagonal", F.struct(F.size("positions"), -F.col("diagonal"))).alias("first"), F.sum(F.size("positions")).alias("n"),
                 F.collect_list("diagonal").alias("diagonals"), F.collect_list("positions").alias("positions"))
            .where(F.col("n") >= enough).drop("span", "grams", "n"))
    near = near.mapInArrow(verify_batches, "rid long, template int, first long, chain long")
    near = (near.join(F.broadcast(facts), "template").withColumn("score", F.col("chain") / F.col("grams"))
            .where(F.col("score") >= MIN_SCORE).select("rid", "label", "first", "score", "is_base"))
    spans = staged(exact.unionByName(near), "spans")

    per = spans.groupBy("rid").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"), F.min(F.when(F.col("is_base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"))
    out = (votes.where("template = -1").select("rid", "id", "n_words").join(per, "rid", "left")
           .fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}))
    return out, spans


@query("op7_license_scan")
def op7_license_scan(spark, d):
    out, _ = scan_licenses(table(spark, d, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                      "base_labels", "labels", "score")
