"""License scans by diagonal voting, in DataFrame operations alone.

A text's rolling runs of K words are hashed where the text is parsed, once; those whose hash a license template has are
joined to the places they have in the templates and compared word for word. A hit at word p of the text and word t of a
template votes for the diagonal p - t; votes are counted by diagonal, diagonals that lie within SLACK of each other are
merged (words may be missing or added), and the merged span is verified: it must hold at least `share` of the template's
runs, within the template's length and the slack. The templates are fixed text, so the joined side is small whatever the
input.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case. Base phrases are counted
apart and their labels always stay.

Defined results: a null or empty text has no words, no labels (empty strings) and score 0. Equal rows of the input have
equal results, a row each; rows that share a doc_id but not a text are kept apart by a hash of both. The score is 1 if a
base phrase occurs, else the largest verified share. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

K, SLACK, SHARE = 3, 2, 0.6
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license texts and notices, in words.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]


def run_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(K)))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, at, run, runs, h): the templates' runs with their places. A fixed table."""
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        w = text.split()
        rows += [(k, label, t, " ".join(w[t : t + K]), len(w) - K + 1) for t in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, at int, run string, runs int").withColumn("h", run_hash(F.split("run", " "), F.lit(0)))


def phrase_at(words: Column, i: Column, phrase: str) -> Column:
    out = None
    for k, w in enumerate(phrase.split()):
        one = F.get(words, i + k) == w
        out = one if out is None else out & one
    return F.coalesce(out, F.lit(False))


def _holds(phrase: str):
    return lambda i: phrase_at(F.col("words"), i, phrase)


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() does as well, but for the Kelvin sign, the one other character that becomes a word's
    ASCII letter by itself; other letters' case never matters, as all words looked for are ASCII."""
    return F.when(F.contains(text, F.lit("\u212a")), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def scan(docs: DataFrame, share: float = SHARE) -> DataFrame:
    spark = docs.sparkSession
    t = templates(spark)
    hashes = [r["h"] for r in t.select("h").distinct().collect()]  # the fixed table's
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("uid"), F.regexp_extract_all(lowered(F.coalesce(F.col("text"), F.lit(""))), F.lit(PATTERN), F.lit(0)).alias("words"))
    words, n = F.col("words"), F.size("words")
    none = F.array().cast("array<int>")
    # Words that begin a base phrase, and runs that a template has, come first; all else is compared at those few places.
    heads = sorted({p.split()[0] for p in BASE})
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, i).isin(heads))).otherwise(none)
    runs = F.when(n >= K, F.filter(F.sequence(F.lit(0), n - K), lambda i: run_hash(words, i).isin(hashes))).otherwise(none)
    found = split.select("doc_id", "uid", "words", n.cast("long").alias("n_words"), F.filter(starts, lambda i: _any(phrase_at(words, i, p) for p in BASE)).alias("places"), runs.alias("runs"))
    labels = F.filter(F.array(*[F.when(F.exists("places", _holds(p)), F.lit(x)) for p, x in BASE.items()]), lambda x: x.isNotNull())
    run = F.transform("runs", lambda i: F.struct(i.alias("p"), F.concat_ws(" ", *(F.get(words, i + k) for k in range(K))).alias("run")))
    found = found.select("doc_id", "uid", "n_words", F.size("places").cast("long").alias("n_base"), F.get("places", F.lit(0)).cast("long").alias("first_word"), F.get("places", F.size("places") - 1).cast("long").alias("last_word"), F.array_sort(labels).alias("base"), run.alias("hits"))
    parsed = cut(found, "parsed")  # texts are parsed once; what is left is small
    based = parsed.drop("hits")

    hits = parsed.select("doc_id", "uid", F.explode("hits").alias("hit")).select("doc_id", "uid", "hit.p", "hit.run").withColumn("h", run_hash(F.split("run", " "), F.lit(0)))
    hits = hits.join(F.broadcast(t.withColumnRenamed("run", "template_run")), "h").where("run = template_run")
    hits = hits.select("doc_id", "uid", "template", "label", "runs", "p", (F.col("p") - F.col("at")).alias("diagonal"))
    votes = hits.distinct().groupBy("doc_id", "uid", "template", "label", "runs", "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"))
    order = Window.partitionBy("doc_id", "uid", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(1))
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order))
    spans = merged.groupBy("doc_id", "uid", "template", "label", "runs", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    share_of = F.least(F.lit(1.0), F.col("votes") / F.col("runs"))
    found = spans.withColumn("share", share_of).where((F.col("share") >= share) & (F.col("last") - F.col("first") < F.col("runs") + F.col("high") - F.col("low")))
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))

    out = based.join(found, based["doc_id"].eqNullSafe(found["d"]) & (based["uid"] == found["u"]), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT template, label, string_split(txt, ' ') AS w FROM (VALUES {_VALUES}) v(template, label, txt)),
t AS (SELECT template, label, len(w) - {K - 1} AS runs, i - 1 AS a, array_to_string(w[i : i + {K - 1}], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM s)),
p AS (SELECT r, i - 1 AS p, array_to_string(w[i : i + {K - 1}], ' ') AS run, w[i] AS w0, w[i + 1] AS w1 FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {K - 2}, 1))) AS i FROM d)),
pairs AS (SELECT r, i - 1 AS p FROM (SELECT r, w, unnest(range(1, greatest(len(w), 1))) AS i FROM d) WHERE w[i] = 'cc' AND w[i + 1] = 'by'),
base AS (SELECT r, p, 'cc-by' AS label FROM pairs UNION ALL SELECT r, p, 'gpl' FROM p WHERE run = 'general public license' UNION ALL SELECT r, p, 'reserved' FROM p WHERE run = 'all rights reserved'),
bases AS (SELECT r, count(*) AS n, min(p) AS f, max(p) AS l, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r),
votes AS (SELECT r, template, label, runs, p - a AS diagonal, count(*) AS votes, min(p) AS f, max(p) AS l FROM (SELECT DISTINCT r, template, label, runs, p, a FROM p JOIN t USING (run)) GROUP BY ALL),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS fresh FROM votes),
merged AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM fresh),
spans AS (SELECT r, label, least(1.0::DOUBLE, sum(votes)::DOUBLE / runs) AS share, max(l) - min(f) < runs + max(diagonal) - min(diagonal) AS tight FROM merged GROUP BY r, template, label, runs, span),
own AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM spans WHERE share >= {SHARE} AND tight GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       coalesce(array_to_string(bases.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []::VARCHAR[]), coalesce(own.labels, []::VARCHAR[])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN bases USING (r) LEFT JOIN own USING (r)
"""
