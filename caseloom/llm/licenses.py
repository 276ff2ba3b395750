"""License scans by diagonal voting, with DataFrame functions alone.

The hashes of all word pairs of a document are joined to the grams of license templates, by their first two words:
grams are pairs for short templates, and four words for those of LONG words and more, whose pairs are too common. A
match, verified by all its words, at document word d and template word t votes for the diagonal d - t; votes on one
diagonal, and then on neighbouring diagonals (words put in or left out), add up to a span. A span is a chain of
matches, each later than the one before in document and template and at most NEIGHBOUR diagonals off, so that none
counts twice; it counts when enough of the template's grams are met. Base phrases count where all their pairs stand
on one diagonal.

Templates are a parameter, texts with labels, which ``digest_of`` tells apart; TEMPLATES is what they are by default.

Null text counts as empty: no words, no places, labels '' and score 0. Texts are scanned whole. Labels that tie
are all given, sorted. Rows that repeat id and text share one result, null ids among them. An empty table gives
no row. Columns of the documents but id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, LOWER, UPPER, ascii_lower, keyed, words

#: Grams of templates up to which they are broadcast, some 20 MB; beyond it they are joined by shuffle.
BROADCAST_GRAMS = 200_000

# The phrases that must be found, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words, notices and passages of well-known licenses, which the method looks for besides.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache",
    "spdx license identifier apache 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "spdx license identifier mit": "mit",
    "free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version": "mpl",
    "creative commons attribution 4 0 international license": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "spdx license identifier gpl": "gpl",
    "spdx license identifier lgpl": "lgpl",
    "spdx license identifier bsd": "bsd",
    "spdx license identifier mpl": "mpl",
    "spdx license identifier isc": "isc",
    "spdx license identifier unlicense": "unlicense",
    # Bodies and notices.
    """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. The software is provided as is, without warranty of any kind, express or implied, including but not limited to
    the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or
    copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or
    otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.""": "mit",
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution.""": "bsd",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies.""": "isc",
    """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
    as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific
    language governing permissions and limitations under the License.""": "apache",
    """This program is distributed in the hope that it will be useful, but without any warranty; without even the implied
    warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.""": "gpl",
    """This library is distributed in the hope that it will be useful, but without any warranty; without even the implied
    warranty of merchantability or fitness for a particular purpose. See the GNU Lesser General Public License for more
    details.""": "lgpl",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at""": "mpl",
    """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
    as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""": "unlicense",
    """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
    purpose, including commercial applications, and to alter it and redistribute it freely""": "zlib",
    """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the
    Software""": "boost",
}
#: Templates of so many words vote by grams of four words, others by pairs.
LONG = 20
#: Share of a template's voting grams that a span must meet, by the words of a gram, and how far diagonals may lie apart.
LEAST_COVER, NEIGHBOUR = {2: 0.75, 4: 0.4}, 3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """The words of a template, as documents are cut."""
    return WORD.findall(text.translate(str.maketrans(UPPER, LOWER)))


def gram_size(text: str) -> int:
    return 4 if len(words_of(text)) >= LONG else 2


def digest_of(templates: Mapping[str, str]) -> str:
    """Of a list of templates and labels, whatever its order."""
    return hashlib.sha256("\n".join(sorted(f"{' '.join(words_of(t))}\t{label}" for t, label in templates.items())).encode()).hexdigest()


def grams(templates: Mapping[str, str]) -> list[tuple]:
    """Rows (template, label, base, votes it can get, words of a gram, position, and its words, null where it has but two)."""
    rows = []
    for k, (text, label) in enumerate([*BASE.items(), *templates.items()]):
        w, size = words_of(text), 2 if k < len(BASE) else gram_size(text)
        if len(w) < 2 or "," in label:
            raise ValueError(f"a template has two words at least, and a label no comma: {text[:40]!r}, {label!r}")
        of = [w[i : i + size] for i in range(len(w) - size + 1)]
        rows += [(k, label, k < len(BASE), len(of), size, i, *g, *[None] * (4 - size)) for i, g in enumerate(of)]
    return rows


def longest_chain(matches: Column, reach: int) -> Column:
    """Length of the longest chain among matches, structs (at, tpos) by at; none spans more than reach between neighbours."""
    start = F.struct(F.lit(0).alias("best"), F.array().cast("array<struct<at:int,tpos:int,n:int>>").alias("late"))

    def add(state: Column, m: Column) -> Column:
        late = F.filter(state["late"], lambda r: r["at"] >= m["at"] - reach)
        drift = lambda r: F.abs(m["at"] - m["tpos"] - r["at"] + r["tpos"])
        before = F.filter(late, lambda r: (r["at"] < m["at"]) & (r["tpos"] < m["tpos"]) & (drift(r) <= NEIGHBOUR))
        n = F.coalesce(F.array_max(F.transform(before, lambda r: r["n"])), F.lit(0)) + 1
        own = F.struct(m["at"].alias("at"), m["tpos"].alias("tpos"), n.alias("n"))
        return F.struct(F.greatest(state["best"], n).alias("best"), F.concat(late, F.array(own)).alias("late"))

    return F.aggregate(matches, start, add, lambda state: state["best"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: id, n_words, places (sorted starts of base phrases), base_labels, labels, score.

    templates: text -> label, looked for beside the base phrases. score is the best share of a template's grams that any
    span meets. The grams are broadcast if they have at most BROADCAST_GRAMS rows.
    """
    spark = docs.sparkSession
    listed = grams(templates)
    table = spark.createDataFrame(listed, "tpl int, label string, base boolean, votes int, size int, tpos int, a string, b string, c string, d string").withColumn("h", F.xxhash64("a", "b"))
    table = F.broadcast(table) if len(listed) <= BROADCAST_GRAMS else table
    bodies = keyed(docs, id_col, text_col)
    lists = bodies.select(*KEY, words(ascii_lower(F.col("k_body"))).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1))))
    scanned = lists.select(*KEY, "w", F.posexplode(pairs).alias("at", "h"))
    stands = [F.coalesce(F.get("w", F.col("at") + i) == F.col(c), F.col(c).isNull()) for i, c in enumerate("abcd")]
    met = scanned.join(table, "h").where(stands[0] & stands[1] & stands[2] & stands[3])
    diagonal = met.groupBy(*KEY, "tpl", "label", "base", "votes", "size", (F.col("at") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("cast"))

    lines = diagonal.groupBy(*KEY, "tpl", "label", "base", "votes", "size").agg(
        F.collect_list(F.struct("diagonal", "cast")).alias("lines"),
        F.collect_list(F.when(F.col("base") & (F.size("cast") == F.col("votes")), F.col("diagonal"))).alias("places"),
    )
    matches = F.array_sort(F.flatten(F.transform("lines", lambda s: F.transform(s["cast"], lambda t: F.struct((s["diagonal"] + t).alias("at"), t.alias("tpos"))))))
    reach = max(r[5] for r in listed) + NEIGHBOUR
    chain = F.when(F.size("lines") == 1, F.size(F.get("lines", F.lit(0))["cast"])).otherwise(longest_chain(matches, reach))
    spans = lines.withColumn("cover", chain / F.col("votes"))
    least = F.when(F.col("size") == 2, LEAST_COVER[2]).otherwise(LEAST_COVER[4])
    sure = (~F.col("base") & (F.col("cover") >= least)) | (F.size("places") > 0)
    by_doc = spans.groupBy(*KEY).agg(
        F.array_sort(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_sort(F.collect_set(F.when(F.size("places") > 0, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(sure, F.col("label")))).alias("labels"),
        F.max("cover").alias("score"),
    )
    joined = bodies.select(*KEY, "k_id", F.size(words(F.col("k_body"))).cast("long").alias("n_words")).join(by_doc, KEY, "left")
    return joined.select(
        F.col("k_id").alias(id_col),
        "n_words",
        F.coalesce("places", F.array().cast("array<int>")).alias("places"),
        F.array_join(F.coalesce("base_labels", F.array().cast("array<string>")), ",").alias("base_labels"),
        F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
