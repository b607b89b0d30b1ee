"""License scan (DataFrame operations only).

Phrases are counted where their words stand consecutively. Beyond them, an exact
set-similarity join finds every text block (LINES consecutive lines that have words) that
contains at least SHARE of a template's words, or all of a template of fewer than WHOLE, as in
a short notice each word tells licenses apart: words are ordered by how many
lines of the whole corpus have them, rarest first; a block and a template that
overlap enough must share a word within both prefixes (prefix filter), the block
must be long enough (length filter), and what remains after the shared word must
suffice (positional filter). Candidates are verified by counting.

Only words of templates can add to an overlap, so blocks are reduced to these
when the text is read, once. Frequencies, the join and the result work on that
reduced table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening sentences and short notices of public licenses, in lower case.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
}

LINES = 4
SHARE = 0.8
WHOLE = 10

#: What parts words. Texts are not lower-cased as a whole: letters other than A-Z must stay.
_OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OUT_CHARS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Private letters: one stands for the end of a line, the other for what a text has of the first, and for the Kelvin sign, whose lower case is a k.
_LINE, _OTHER, _KELVIN = "\ue000", "\ue001", "\u212a"


def least_overlap(n: int, share: float, whole: int = WHOLE) -> int:
    return n if n < whole else math.ceil(share * n - 1e-9)


def places_of(words: Column, phrases) -> Column:
    """start (from 0) and phrase of every place where the words of a phrase stand consecutively; words: in lower case, ascending starts."""
    own = [p.split(" ") for p in phrases]
    begins = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(*sorted({p[0] for p in own})))

    def at(i):
        found = []
        for p in own:
            fits = F.lit(True)
            for k, w in enumerate(p):
                fits = fits & (F.try_element_at(words, i + k) == w)
            found.append(F.when(fits, F.struct((i - 1).cast("long").alias("start"), F.lit(" ".join(p)).alias("phrase"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.flatten(F.transform(begins, at))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, lines: int = LINES, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score is 1 with a phrase, else the largest share of a template that a matching block has,
    else 0. A null text has no words; repeated rows each get a row; no rows give no rows.

    Each text is split into words once, with a mark for each line end, of which one stays between lines that have words. Only words of templates and
    phrases go on from there; texts in which these leave a phrase possible are looked at for its places.
    """
    vocab = sorted({w for t in [*templates, *phrases] for w in t.split()})
    text = F.replace(F.replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(_KELVIN), F.lit(_OTHER)), F.lit(_LINE), F.lit(_OTHER))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.btrim(text, F.lit(_OUT_CHARS)).alias("t"))
    rows = rows.withColumn("w", F.split(F.replace("t", F.lit("\n"), F.lit(f" {_LINE} ")), f"{_OUT}+", -1))
    rows = rows.select("doc_id", "t", F.size("w").alias("size"), F.transform(F.filter("w", lambda x, i: F.lower(x).isin(*vocab) | (x == _LINE) & (F.get("w", i - 1) != _LINE)), F.lower).alias("known"))
    ends = F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit("")))
    rows = rows.select("doc_id", "t", "size", F.array_join("known", " ").alias("known"), ends.alias("ends"), F.array_join(F.array_remove("known", _LINE), " ").alias("run"))
    possible = F.lit(False)
    for p in phrases:
        possible = possible | F.contains(F.concat(F.lit(" "), "run", F.lit(" ")), F.lit(f" {p} "))
    hits = F.when(possible, places_of(F.col("v"), phrases)).otherwise(F.array().cast("array<struct<start:long,phrase:string>>"))
    rows = rows.withColumn("v", F.when(possible, F.transform(F.split("t", f"{_OUT}+", -1), F.lower))).withColumn("hits", hits)
    name, starts = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv]), F.col("hits.start")
    words = F.transform(F.split("known", _LINE), lambda s: F.array_distinct(F.filter(F.split(s, " "), lambda x: x != "")))
    small = rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.when(F.col("t") == "", 0).otherwise(F.col("size") - F.col("ends")).cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("hits.phrase", lambda p: F.element_at(name, p)))).alias("base"), F.when(F.col("run") != "", words).otherwise(F.array().cast("array<array<string>>")).alias("lines"),
    )
    small = written(small, "license-words")
    freq = {w: 0 for w in vocab}
    freq |= {r["w"]: r["n"] for r in small.select(F.explode("lines").alias("l")).select(F.explode("l").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {w: k for k, w in enumerate(sorted(vocab, key=lambda w: (freq[w], w)))}
    index, sets = [], []
    for k, (t, label) in enumerate(sorted(templates.items())):
        own = sorted({order[w] for w in t.split()})
        need = least_overlap(len(own), share)
        sets.append((k, label, own))
        index += [(r, k, i, len(own), need) for i, r in enumerate(own[: len(own) - need + 1])]
    spark = docs.sparkSession
    # the size of both is that of the templates
    index_df = F.broadcast(spark.createDataFrame(index, "rank int, template int, i int, size int, need int"))
    sets_df = F.broadcast(spark.createDataFrame(sets, "template int, label string, own array<int>"))
    fewest = min((x[4] for x in index), default=0)
    ranks = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    block = F.sort_array(F.transform(F.array_distinct(F.flatten(F.slice("lines", F.col("line") + 1, lines))), lambda w: F.element_at(ranks, w)))
    has = small.where(F.exists("lines", lambda x: F.size(x) > 0))
    blocks = has.select("rid", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("line")).select("rid", block.alias("block")).where(F.size("block") >= fewest)
    in_prefix = sorted({x[0] for x in index})
    joined = blocks.where(F.arrays_overlap("block", F.lit(in_prefix))).select("rid", "block", F.posexplode("block").alias("j", "rank")).join(index_df, "rank")
    left_over = F.least(F.col("size") - F.col("i"), F.size("block") - F.col("j"))
    candidates = joined.where((F.size("block") >= F.col("need")) & (left_over >= F.col("need"))).select("rid", "block", "template", "size", "need").distinct()
    matched = candidates.join(sets_df, "template").withColumn("both", F.size(F.array_intersect("block", "own"))).where("both >= need")
    matched = matched.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max(F.col("both") / F.col("size")).alias("best"))
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return small.join(matched, "rid", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.alias("score"))
