"""Licence scans by diagonal voting.

Templates are short word sequences. All rolling word k-grams of the texts are hashed and joined with the
k-grams of the templates; a match votes for the diagonal (place in the text minus place in the template).
Votes are added up per diagonal, each diagonal is merged with its neighbours, since a word more or less moves the
rest of a template by one, and the merged spans are verified: words must be equal, and enough of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joingrove.llm.common import stage, text_key, texts

GRAM = 2  # words; the shortest phrase has two
#: Share of a template's k-grams that an occurrence must hold, and how long its span may be beside the template.
COVER, STRETCH = 0.8, 1.5

# The phrases of the contract (base) and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Sentences that stand in licence texts and notices, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("released under the unlicense", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("boost software license version 1 0", "bsl"),
)

# Whole licence texts and their labels, as their words stand.
LICENCE_TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""", "zlib"),
)

#: Words: digits, letters and all beyond ASCII. Capitals are part of them here and lowered word by word.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool  # all words in a row; else COVER of the k-grams


def templates() -> list[Template]:
    return ([Template(tuple(p.split()), label, True) for p, label in BASE]
            + [Template(tuple(p.split()), label, False) for p, label in NOTICES]
            + [Template(tuple(w.lower() for w in re.findall(WORDS, p)), label, False) for p, label in LICENCE_TEXTS])


def ascii_lower(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Stand behind the k-grams of each text, the second where it has no word; no word holds their characters. They match
#: a template of this number, on the diagonal of the last word: texts are read once for words and matches.
END, END_OF_NONE, LAST_WORD = "\x00", "\x00\x00", -1


def _gram_rows(spark: SparkSession, known: list[Template]) -> DataFrame:
    """A row per k-gram of a template: its hash, its words, its place."""
    rows = [(" ".join(t.words[i:i + GRAM]), n, i) for n, t in enumerate(known) for i in range(len(t.words) - GRAM + 1)]
    rows += [(END, LAST_WORD, 0), (END_OF_NONE, LAST_WORD, 1)]
    return (spark.createDataFrame(rows, "t_gram string, template int, place int")
            .select(F.xxhash64("t_gram").alias("gram"), "t_gram", "template", "place"))


def votes(docs: DataFrame, known: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, template, place, at: verified matches of k-grams, `at` in words from 0; and a row of
    template LAST_WORD for each row of `docs`."""
    spark = docs.sparkSession
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    rows = texts(docs, id_col, text_col).select("doc_id", text_key().alias("key"), words.alias("w"))
    grams = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    end = F.array(F.when(F.size("w") == 0, F.lit(END_OF_NONE)).otherwise(F.lit(END)))
    grams = rows.select("doc_id", "key", F.posexplode(F.concat(grams, end)).alias("at", "raw"))
    # lower() also lowers letters beyond ASCII: it can only add candidates, which the comparison of words drops
    hashed = grams.select("doc_id", "key", "at", "raw", F.xxhash64(F.lower("raw")).alias("gram"))
    matched = hashed.join(F.broadcast(_gram_rows(spark, known)), "gram")  # a fixed number of templates
    return matched.where(ascii_lower(F.col("raw")) == F.col("t_gram")).select("doc_id", "key", "template", "place", "at")


def spans(found: DataFrame, known: list[Template]) -> DataFrame:
    """doc_id, key, template, start, words, cover from `votes`: a row per verified occurrence of a template.

    A base template occurs where all its words stand in a row: its diagonal has every k-gram. Another
    occurs where one diagonal holds COVER of its k-grams, or a diagonal together with those up to `reach` above it does:
    words that were put in or left out move the rest of the template to these, and their matches span no more than STRETCH of
    its length. Each diagonal is the lowest of a group of its own, so matches further along, however many, take nothing
    from it. Of groups that overlap in the text the one with the best cover is the occurrence.
    """
    size = F.create_map(*[F.lit(x) for n, t in enumerate(known) for x in (n, len(t.words))])[F.col("template")]
    base = F.col("template").isin([n for n, t in enumerate(known) if t.base] or [-1])
    reach = F.floor(size * F.lit(STRETCH - 1)).cast("int")
    widest = max([int(len(t.words) * (STRETCH - 1)) for t in known if not t.base], default=0)
    text, total = ["doc_id", "key", "template"], size - (GRAM - 1)
    diagonals = (found.where(F.col("template") != LAST_WORD)
                 .groupBy(*text, (F.col("at") - F.col("place")).alias("diagonal"))
                 .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")))
    phrases = (diagonals.where(base & (F.size("places") >= total))
               .select(*text, F.col("first").cast("long").alias("start"), size.cast("long").alias("words"), F.lit(1.0).alias("cover"), F.lit(True).alias("base")))

    # At most one row a diagonal: a frame holds no more than `widest` + 1.
    ahead = W.partitionBy(*text).orderBy("diagonal").rangeBetween(0, widest)
    group = F.filter(F.collect_list(F.struct("diagonal", "places", "first", "last")).over(ahead), lambda d: d["diagonal"] <= F.col("diagonal") + F.col("reach"))
    grouped = (diagonals.where(~base).withColumn("reach", reach).withColumn("group", group)
               .select(*text, F.size("places").alias("alone"), "first", "last",
                       F.size(F.array_distinct(F.flatten(F.col("group.places")))).alias("together"),
                       F.array_min("group.first").alias("all_first"), F.array_max("group.last").alias("all_last")))
    needed = F.ceil(total * F.lit(COVER))
    one = lambda x, y: F.when(F.col("alone") >= needed, F.col(x)).otherwise(F.col(y))
    verified = (grouped.where(F.col("together") >= needed)
                .select(*text, one("first", "all_first").alias("start"), (one("last", "all_last") + GRAM).alias("end"),
                        (one("alone", "together") / total).alias("cover")))
    line = W.partitionBy(*text).orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    best = F.max(F.struct("cover", (F.col("start") - F.col("end")).alias("short"), (-F.col("start")).alias("early"), "end")).alias("b")
    return phrases.unionByName(
        verified.withColumn("opens", opens).withColumn("n", F.sum("opens").over(line.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*text, "n").agg(best)
        .select(*text, (-F.col("b.early")).cast("long").alias("start"), (F.col("b.end") + F.col("b.early")).cast("long").alias("words"),
                F.col("b.cover").alias("cover"), F.lit(False).alias("base")))


def scan(docs: DataFrame, known: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest start
    (null without one). Labels are distinct, sorted and joined by commas, empty without any. score is the
    best cover of a verified span, 0 without one. A null or empty text has no words; rows repeated with
    their id and text get the same result each.
    """
    known = known or templates()
    label = F.create_map(*[F.lit(x) for n, t in enumerate(known) for x in (n, t.label)])[F.col("template")]
    voted = stage(votes(docs, known, id_col, text_col), "licence-votes")
    found = (spans(voted, known)
             .groupBy("doc_id", "key")
             .agg(F.sum(F.col("base").cast("long")).alias("n_base"),
                  F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
                  F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
                  F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), label))), ",").alias("base_labels"),
                  F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
                  F.max("cover").alias("score")))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"),
                         *[c for c in found.columns if c not in ("doc_id", "key")])
    rows = voted.where(F.col("template") == LAST_WORD).select(
        "doc_id", "key", (F.col("at") - F.col("place") + 1).cast("long").alias("n_words"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.f_id) & (rows.key == found.f_key), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                         F.coalesce("score", F.lit(0.0)).alias("score"))
