"""License notices by diagonal voting.

Every text gives the hashes of all its windows of k words, for each length k that the templates use. Spark joins them to the places where templates hold the
same windows. A meeting of place i in the text and place j in a template votes for the diagonal i - j: a notice that stands word by word is one diagonal, a word
put in or left out starts a neighbouring one. Votes are added up by text, template and diagonal; diagonals no further apart than `drift` (and than a sixteenth of the template) become
one span; and a span is verified by the template's words that its windows cover, which must be at least `share` of the template. A notice of fewer than SHORT words
must stand whole on one diagonal: a word more or less there names another license.

Names of licenses are templates of two words a window that must be covered whole on one diagonal; their places are the base, whose labels always stay. Whole notices use
windows of three words. The score of a text is the greatest share of a notice in it; a name alone counts NAME_SCORE.

Words are letters and digits, A-Z in lower case. A null or empty text has no words, labels or places. Long texts are read whole, in pieces of PIECE windows that lose none.
Rows that agree in key and text have the same answer and are searched together, so repeated rows and rows without a key are answered each. An empty table gives
an empty result. Other columns are not looked at, whatever their names. What is broadcast is the table of templates, which the caller gives, and its size is checked.
Words are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.tables import join_sized
from palimpsest.session import durable, prepare

NAME_WORDS, NOTICE_WORDS = 2, 3
NAME_SCORE = 0.5
SHORT = 16
#: Windows of a text in one row.
PIECE = 1 << 13


class Template(NamedTuple):
    label: str
    text: str
    is_name: bool = False


#: The names of licenses.
NAMES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))

#: The wordings of public licenses and of the notices that refer to them.
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    Template("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mit", "Released under the MIT License"),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(c: K.Chunk) -> K.Words:
    return K.words(c.bytes, c.offsets, K.NON_ALNUM, K.LOWER)


def template_places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """hash, template, label, is_name, place, size (words), k: a row for each window of a template."""
    rows = []
    for i, one in enumerate(templates):
        w = words_of(next(iter(K.chunks(pa.array([one.text])))))
        k = NAME_WORDS if one.is_name else NOTICE_WORDS
        if len(w.hash) < k:
            raise ValueError(f"a template needs {k} words: {one.text!r}")
        h, _, first = K.shingles(w, k)
        rows += [(int(x), i, one.label, one.is_name, int(p), len(w.hash), k) for x, p in zip(h.view(np.int64), first, strict=True)]
    return spark.createDataFrame(rows, "hash long, template int, label string, is_name boolean, place int, size int, k int")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark, text) to rows (key, mark, k, start, hashes): the windows of k words from word `start` on."""
    for batch in batches:
        for c in K.chunks(batch.column(2)):
            w = words_of(c)
            n = len(c.offsets) - 1
            for k in (NAME_WORDS, NOTICE_WORDS):
                h, doc, first = K.shingles(w, k)
                begin = np.searchsorted(w.doc, np.arange(n))  # the first word of each text
                place = first - begin[doc]
                edge = np.flatnonzero((place % PIECE == 0) | (np.diff(doc, prepend=-1) != 0))
                if len(edge):
                    whose = pa.array(c.first + doc[edge])
                    hashes = pa.ListArray.from_arrays(pa.array(np.append(edge, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(whose), batch.column(1).take(whose), pa.array(np.full(len(edge), k, np.int32)), pa.array(place[edge]), hashes], names=["__key", "__mark", "k", "start", "hashes"]
                    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in K.chunks(batch.column(2)):
            n = len(c.offsets) - 1
            counts = K.per_row(K.word_spans(c.bytes, c.offsets, K.NON_ALNUM)[2], n)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, n), batch.column(1).slice(c.first, n), pa.array(counts)], names=["__key", "__mark", "n_words"])


def _body(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("__key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__mark"), F.col(text).alias("__text"))


def spans(docs: DataFrame, templates: tuple[Template, ...] = NAMES + NOTICES, key: str = "doc_id", text: str = "text", drift: int = 4, share: float = 0.8) -> DataFrame:
    """__key, __mark (a hash of the text), template, label, is_name, first, last (words, both included), covered (the share of the template): verified places, one row each and text."""
    spark = prepare(docs.sparkSession)
    body = _body(docs, key, text)
    windows = body.mapInArrow(_windows, f"__key {body.dtypes[0][1]}, __mark long, k int, start long, hashes array<long>")
    each = windows.select("__key", "__mark", "start", F.posexplode("hashes").alias("at", "hash")).select("__key", "__mark", (F.col("start") + F.col("at")).alias("i"), "hash")
    places = durable(template_places(spark, templates).repartition(1), "templates")
    met = join_sized(each, places, "hash")
    whose = ["__key", "__mark", "template", "label", "is_name", "size", "k"]
    votes = met.groupBy(*whose, (F.col("i") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))  # at most the template's windows
    votes = durable(votes, "votes")  # read twice, and far smaller than the texts

    # names: the whole phrase on one diagonal, so diagonals that share a window do not merge
    names = votes.where("is_name AND size(places) = size - k + 1").select(*whose, F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("covered"))

    along = Window.partitionBy(*whose).orderBy("diagonal")
    notices = votes.where("NOT is_name").withColumns({"low": F.array_min("places"), "high": F.array_max("places")})
    # a diagonal goes on with the one before where it is near it: the same notice with words put in or left out
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.least(F.lit(drift), F.floor(F.col("size") / SHORT))
    merged = notices.withColumn("group", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(along))
    merged = merged.groupBy(*whose, "group").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("first"),
        F.max(F.col("diagonal") + F.col("high") + F.col("k") - 1).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    covering = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))))
    merged = merged.withColumn("covered", F.size(covering) / F.col("size")).where(F.col("covered") >= F.when(F.col("size") < SHORT, 1.0).otherwise(share))
    columns = ["__key", "__mark", "template", "label", "is_name", "first", "last", "covered"]
    return names.select(*columns).unionByName(merged.select(*columns))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = NAMES + NOTICES, key: str = "doc_id", text: str = "text", drift: int = 4, share: float = 0.8) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, n_notices, score: one row a document."""
    found = spans(docs, templates, key, text, drift, share)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    base = F.when(F.col("is_name"), F.col("first"))
    one = found.groupBy("__key", "__mark").agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        joined(F.collect_set(F.when(F.col("is_name"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.count(F.when(~F.col("is_name"), 1)).alias("n_notices"),
        F.max(F.when(F.col("is_name"), NAME_SCORE).otherwise(F.col("covered"))).alias("score"),
    )
    one = durable(one.withColumnsRenamed({"__key": "__k", "__mark": "__m"}), "licenses")
    body = _body(docs, key, text)
    counted = body.mapInArrow(_counted, f"__key {body.dtypes[0][1]}, __mark long, n_words long")
    out = join_sized(counted, one, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__mark") == F.col("__m")), "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select(F.col("__key").alias(key), "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("n_notices", 0), none("score", 0.0))
