"""License scan by diagonal voting, in DataFrame functions alone.

Every window of three words of every text is joined, by a hash and by the words themselves, to the
positions where the same three words stand in a license template. A hit votes for its diagonal (position in the
text less position in the template), and neighbouring diagonals are merged, which lets
words be added or left out. The span between a band's first and last hit is then verified: hits must
cover enough words of the template and enough words of the span. A diagonal with all votes of a base phrase is a
place where all its words stand in a row.

Windows whose hash no template has are left out before the join, which so sees few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 3
#: What stands between words: all of ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Base phrases (fixed values): their places are counted and their labels always given.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Paragraphs and notices of well-known licenses, as published (fixed values); they add labels.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions"""),
    ("mit", """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies"""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at"""),
    ("apache-2", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License"""),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met"""),
    ("bsd", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer"""),
    ("bsd", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"""),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"""),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means"""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software"""),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]


def _words(text):
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), BETWEEN), "")


def _templates(spark, base, templates) -> DataFrame:
    """A row for each three words of each template; bounded by the length of the lists given."""
    rows = [(t, is_base, label, text) for t, (is_base, label, text) in enumerate([(True, *e) for e in base] + [(False, *e) for e in templates])]
    known = spark.createDataFrame(rows, "t int, is_base boolean, label string, text string").withColumn("tw", _words(F.col("text")))
    short = known.where(F.size("tw") < K).first()
    if short:
        raise ValueError(f"a template needs {K} words: {short['text']!r}")
    at = F.explode(F.sequence(F.lit(0), F.size("tw") - K))
    known = known.select("t", "is_base", "label", F.size("tw").alias("t_words"), "tw", at.alias("tpos"))
    known = known.select("t", "is_base", "label", "t_words", "tpos", *[F.get("tw", F.col("tpos") + k).alias(f"t{k + 1}") for k in range(K)])
    return known.withColumn("th", F.xxhash64("t1", "t2", "t3"))


def _covered(starts):
    """How many words hits at these positions cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (K - 1))))))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: list[tuple[str, str]] = BASE,
    templates: list[tuple[str, str]] = TEMPLATES,
    slack: int = 2,
    least: float = 0.6,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    Words are runs of digits, lower-case letters and non-ASCII characters after A-Z is lower-cased.
    ``n_base`` counts the places of all base phrases, ``first_word`` and ``last_word`` are
    the smallest and largest of their starts. A template adds its label where a band of diagonals at
    most ``slack`` apart is verified: its hits cover ``least`` of the template's words and of
    the words between the first and the last hit. ``spans`` lists the verified ones as ``label, first_word, end_word, share``
    (end exclusive), and ``score`` is the best share of a template covered, verified or not. Null and empty
    texts have no words and no labels. Rows that repeat an id, null ones included, are documents of their own, and come out
    as often as they went in. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    known = _templates(docs.sparkSession, base, templates)
    prints = [r["th"] for r in known.select("th").distinct().collect()]  # bounded by the templates
    of = ["doc_id", "h", "n_words"]  # equal rows have equal results and are one group until the end
    text = F.col(text_col)
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), _words(text).alias("w")).withColumn("n_words", F.size("w"))
    windows = F.expr(
        f"CASE WHEN n_words >= {K} THEN transform(sequence(0, n_words - {K}), i -> struct(i AS pos, get(w, i) AS w1, get(w, i + 1) AS w2, get(w, i + 2) AS w3, xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) AS g)) END"
    )
    hits = F.filter(windows, lambda x: x["g"].isin(prints))
    # a row for each hit and one without, which stands for the document
    every = F.concat(F.coalesce(hits, F.expr("array()")), F.array(F.expr("named_struct('pos', CAST(NULL AS INT), 'w1', CAST(NULL AS STRING), 'w2', CAST(NULL AS STRING), 'w3', CAST(NULL AS STRING), 'g', CAST(NULL AS BIGINT))")))
    seeds = read.select(*of, F.explode(every).alias("x")).select(*of, "x.*")
    same = (F.col("g") == F.col("th")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))
    found = seeds.join(F.broadcast(known), same, "left")
    what = ["t", "is_base", "label", "t_words"]
    votes = found.groupBy(*of, *what, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("tpos"), F.count("*").alias("copies"))
    per = W.partitionBy(*of, "t").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(per) <= slack, 0).otherwise(1)
    bands = votes.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(per))
    full = F.col("is_base") & (F.size("tpos") == F.col("t_words") - (K - 1))
    bands = bands.groupBy(*of, *what, "band").agg(
        F.flatten(F.collect_list("tpos")).alias("tpos"),
        F.flatten(F.collect_list(F.transform("tpos", lambda p: p + F.col("diagonal")))).alias("pos"),
        F.count(F.when(full, 1)).alias("places"),
        F.min(F.when(full, F.col("diagonal"))).alias("first"),
        F.max(F.when(full, F.col("diagonal"))).alias("last"),
        F.max("copies").alias("copies"),
    )
    start, end = F.array_min("pos"), F.array_max("pos") + K
    bands = bands.withColumns({"share": _covered(F.col("tpos")) / F.col("t_words"), "dense": _covered(F.col("pos")) / (end - start)})
    verified = F.when(F.col("is_base"), F.col("places") > 0).otherwise((F.col("share") >= least) & (F.col("dense") >= least))
    span = F.when(verified, F.struct("label", start.cast("long").alias("first_word"), end.cast("long").alias("end_word"), F.round("share", 6).alias("share")))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = bands.groupBy(*of).agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        listed(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
        listed(F.when(verified, F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.max(F.when(F.col("t").isNull(), F.col("copies"))).cast("int").alias("copies"),
    )
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
