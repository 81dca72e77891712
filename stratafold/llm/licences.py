"""License scans by diagonal voting.

Texts and templates are words (A-Z lower-cased). Every run of three words of every
text is hashed and joined with the runs of the templates, and its words are
compared with theirs; a hit votes for the diagonal (place in the text minus place
in the template). Diagonals within ``DRIFT`` words of one another are one passage
with words more or less. A passage is verified by what of the template it holds:
the different runs of the template found in it, over all of them, must reach the
coverage, and the template's key phrase must stand in it complete, which tells
one licence from the next; a run that only repeats counts once. The short base
phrases count only complete, on one diagonal.

The templates are constants of this module, about a thousand runs in all, so their
side of the join is broadcast. Before the join a table of bits over the hashes,
also a constant, drops the runs that no template has, so that only hits become
rows; it never drops one that a template has.

In DataFrame functions only. Each row carries a number through one exchange of the
few rows with votes and of one row per document. Null texts count as empty; a very
long text is one row of words within its task; repeated rows, equal doc_ids and
null ids give a row each; other columns are ignored, whatever their names; empty
tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wordings of public licence notices, as (label, key phrase, words). The key phrase is part of the words.
TEMPLATES = (
    ("mit", "hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "authors or copyright holders", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "the mit license", "licensed under the mit license"),
    ("mit", "the mit license", "released under the mit license"),
    ("mit", "the mit license", "distributed under the terms of the mit license"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "distributed under the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "apache license 2 0", "licensed under the apache license 2 0"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "endorse or promote products", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("gpl", "the gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "the gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "the gnu general public license", "licensed under the gnu general public license"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "gnu affero general public license", "licensed under the gnu affero general public license"),
    ("mpl-2", "the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl-2", "the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("cc0", "waived all copyright", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "attribution noncommercial 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "attribution noderivatives 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "attribution noncommercial noderivatives 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
)
K_WORDS = 3
COVERAGE = 0.6
#: Words by which the place of a passage may shift within it.
DRIFT = 8
BITS = 1 << 16
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _run(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(K_WORDS)))


def _spelt(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", *(F.get(words, i + j) for j in range(K_WORDS)))


def entries() -> list[tuple[int, str, bool, str, int, int]]:
    """(template, label, is a base phrase, words, first and last run of the key phrase)."""
    rows = [(label, True, text, text) for text, label in BASE.items()] + [(label, False, text, key) for label, key, text in TEMPLATES]
    out = []
    for n, (label, base, text, key) in enumerate(rows):
        at = f" {text} ".index(f" {key} ")
        first = text[:at].count(" ")
        out.append((n, label, base, text, first, first + key.count(" ") + 1 - K_WORDS))
    return out


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, runs, need, at, run, spelt): every run of every template and phrase."""
    schema = "template int, label string, base boolean, text string, key_first int, key_last int"
    words = F.split("text", " ")
    table = spark.createDataFrame(entries(), schema).withColumn("words", words).withColumn("runs", F.size("words") - (K_WORDS - 1))
    need = F.sequence("key_first", "key_last")
    rows = table.select("template", "label", "base", "runs", need.alias("need"), "words", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("at"))
    return rows.select("template", "label", "base", "runs", "need", "at", _run(F.col("words"), F.col("at")).alias("run"), _spelt(F.col("words"), F.col("at")).alias("spelt"))


def _bit_table(known: DataFrame) -> Column:
    """A constant array: is the place of a hash taken by a template's run."""
    taken = {r[0] % BITS for r in known.select("run").collect()}
    return F.split(F.lit(",".join("1" if b in taken else "0" for b in range(BITS))), ",").cast("array<boolean>")


def scan(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest share of a template's runs in a verified or unverified passage, 1 for a complete base phrase.
    """
    known = templates(docs.sparkSession)
    bits = _bit_table(known)
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    places = F.when(F.size("words") >= K_WORDS, F.sequence(F.lit(0), F.greatest(F.size("words") - K_WORDS, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    likely = F.filter(places, lambda i: F.get(bits, F.pmod(_run(F.col("words"), i), F.lit(BITS)).cast("int")))
    found = F.transform(likely, lambda i: F.struct(i.alias("place"), _run(F.col("words"), i).alias("run"), _spelt(F.col("words"), i).alias("spelt")))
    # A row of place -1 comes first and carries the document.
    first = F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("long").alias("run"), F.lit(None).cast("string").alias("spelt")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words.alias("words"))
    rows = rows.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(first, found)).alias("hit"))
    rows = rows.select("rid", "doc_id", "n_words", "hit.place", "hit.run", "hit.spelt")
    hits = rows.join(F.broadcast(known), ["run", "spelt"], "left").where("place = -1 or template is not null")
    heads = F.max(F.when(F.col("place") == -1, F.struct("doc_id", "n_words")))
    diagonal = F.col("place") - F.col("at")
    votes = hits.groupBy("rid", "template", "label", "base", "runs", "need", diagonal.alias("diagonal")).agg(heads.alias("head"), F.collect_list("at").alias("ats"))
    # A diagonal has each of the template's runs once at most, so lists and windows are bounded by the templates.
    around = W.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    passage = F.array_distinct(F.flatten(F.collect_list("ats").over(around)))
    held = votes.withColumn("held", F.when(F.col("base"), F.col("ats")).otherwise(passage))
    share = F.when(F.col("runs").isNotNull(), F.size("held") / F.col("runs"))
    whole = F.col("base") & (F.size("held") == F.col("runs"))
    verified = whole | ~F.col("base") & (share >= coverage) & (F.size(F.array_except("need", "held")) == 0)
    return (
        held.groupBy("rid")
        .agg(
            F.max("head").alias("head"),
            F.sum(whole.cast("long")).alias("n_base"),
            F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(verified, F.col("label")))), ",").alias("labels"),
            F.max(F.when(F.col("base") & ~whole, 0.0).otherwise(share)).alias("score"),
        )
        .select("head.doc_id", "head.n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", "base_labels", "labels", F.coalesce("score", F.lit(0.0)).alias("score"))
    )


def normal_words(text: str | None) -> list[str]:
    """The words of a text, as the scan sees them (for tests and templates)."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
