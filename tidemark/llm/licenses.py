"""License scans: phrases at word positions, and license templates found by an exact set-similarity join.

All of it is DataFrame expressions. The join orders tokens by their frequency over all documents, rarest first, and admits
a block as a candidate only through prefix, length and positional filters; candidates are then counted exactly, so every
block that meets the containment threshold is found.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialize

#: Phrases and the labels that they stand for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License templates by label.
TEMPLATES = {
    "agpl": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache": "Licensed under the Apache License, Version 2.0",
    "apache-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "boost": "Distributed under the Boost Software License, Version 1.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This work has been released into the public domain",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
CONTAINMENT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of nothing but white space ends a block, so that wrapped notices are one block.
BLANK_LINE = r"\n[ \t\r\x0B\x0C]*\n"
#: A word before A-Z are lower-cased; lower-cased, it is a run of a-z, 0-9 and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text, before A-Z are lower-cased; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def blocks_of(text: Column) -> Column:
    """Runs of lines between blank lines; null has none."""
    return F.split(text, BLANK_LINE)


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, which a plain column inside a lambda would not be."""
    return F.transform(F.array(value), use)[0]


def phrase_hits(text: Column, phrases: dict[str, str]) -> Column:
    """``array<struct<at, label>>``: the word position of every place where a phrase's words stand one after another.

    A text is opened word by word only if the phrase's words and gaps occur in it; Java's ``(?i)`` folds A-Z alone.
    """
    some = "(?i)(?:" + "|".join(GAP.join(tokens_of(p)) for p in phrases) + ")"

    def one(w: Column, toks: list[str], label: str) -> Column:
        def here(i: Column) -> Column:
            out = F.get(w, i) == toks[0]
            for k in range(1, len(toks)):
                out = out & (F.get(w, i + k) == toks[k])
            return F.coalesce(out, F.lit(False))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(w)), here), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    def places(w: Column) -> Column:
        return F.concat(*[one(w, tokens_of(p), label) for p, label in phrases.items()])

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(text.rlike(some), _bound(F.transform(words(text), lower_ascii), places)).otherwise(none)


def token_order(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> list[str]:
    """Template tokens by the number of documents that hold them, rarest first; ties by token. Counts all documents and
    brings one number per template token to the driver. Tokens without any document come first."""
    low = F.split(F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), GAP)  # the one character beyond ASCII that lower() turns into an ASCII letter
    seen = docs.select(F.explode(F.array_intersect(_literal(vocabulary), low)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = {r["token"]: r["n"] for r in seen.collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def prefix_index(templates: dict[str, str], order: list[str], containment: float) -> list[tuple[str, str, int, int, int, list[str]]]:
    """(token, label, position, size, needed, tokens) for each token of each template's prefix in the global order."""
    rank = {t: k for k, t in enumerate(order)}
    out = []
    for label, text in templates.items():
        toks = sorted(set(tokens_of(text)), key=rank.__getitem__)
        need = max(1, math.ceil(containment * len(toks) - 1e-9))
        out += [(t, label, k, len(toks), need, toks) for k, t in enumerate(toks[: len(toks) - need + 1])]
    return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, hits array<struct<at,label>>, found array<struct<label,containment,block>>`` for each document.

    ``hits`` are all places of the phrases. ``found`` are the template matches: a block is a run of lines between blank ones
    (so what any single line holds, its block holds too); it matches when it holds ``containment`` or more of the template's
    distinct words. Of equal labels the best block is kept, of equal blocks the first; ``block`` is its place among
    ``blocks_of`` the text.

    Nulls: a null text has no words and no blocks; ids may be null. Repeated rows each give their row. Empty tables give no
    rows. Other columns are not looked at. The tokens of the templates are the only things ever broadcast or collected.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    text = F.col(text_col)
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    vocabulary = sorted({t for x in templates.values() for t in tokens_of(x)})
    order = token_order(docs, vocabulary, text_col) if vocabulary else []
    index = prefix_index(templates, order, containment)
    n_words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    hits = F.coalesce(phrase_hits(text, phrases), F.array().cast("array<struct<at:bigint,label:string>>")) if phrases else F.array().cast("array<struct<at:bigint,label:string>>")
    none = F.array().cast("array<struct<label:string,containment:double,block:int>>")
    if not index:
        return docs.select(F.col(id_col).alias("id"), n_words.alias("n_words"), hits.alias("hits"), none.alias("found"))
    # Prefix filter on the blocks: without a token of some template's prefix no template can be contained.
    edge = r"(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    prefix = f"(?i){edge}(?:" + "|".join(sorted({x[0] for x in index})) + r")(?:$|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    least = min(x[4] for x in index)
    # A block's template tokens in the global order: array_intersect keeps the order of its first argument.
    held = lambda x: F.when(x.rlike(prefix), F.array_intersect(_literal(order), F.transform(words(x), lower_ascii)))
    tokens = F.transform(blocks_of(text), lambda x, k: F.struct(k.alias("block"), held(x).alias("b")))
    blocks = F.when(text.rlike(prefix), F.filter(tokens, lambda x: F.size(x["b"]) >= least))
    kind = "array<struct<block:int,b:array<string>>>"
    base = materialize(docs.select(key.alias("key"), n_words.alias("n_words"), hits.alias("hits"), F.coalesce(blocks, F.array().cast(kind)).alias("blocks")), "licenses")
    blocks = base.filter(F.size("blocks") > 0).select("key", F.inline("blocks"))
    probes = blocks.select("key", "block", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - least + 1)).alias("j", "token"))
    build = spark.createDataFrame(index, "token string, label string, i int, size int, need int, t array<string>")
    pairs = probes.join(F.broadcast(build), "token")  # bounded: the prefixes of the given templates
    size_b = F.size("b")
    pairs = pairs.filter((size_b >= F.col("need")) & (F.col("j") <= size_b - F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, size_b - F.col("j") - 1) >= F.col("need")))
    overlap = F.size(F.array_intersect("b", "t"))
    sure = pairs.filter(overlap >= F.col("need")).select("key", "label", (overlap / F.col("size")).alias("containment"), "block")
    best = sure.groupBy("key", "label").agg(F.max(F.struct("containment", (-F.col("block")).alias("at"))).alias("m"))
    found = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", F.col("m.containment").alias("containment"), (-F.col("m.at")).cast("int").alias("block")))).alias("found"))
    out = base.drop("blocks").join(found.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left")
    return out.select(F.col("key.id").alias("id"), "n_words", "hits", F.coalesce("found", none).alias("found"))


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: words, phrase places with their first and last word, labels of phrases and of both, and a score."""
    base = F.array_sort(F.array_distinct(F.col("hits.label")))
    return scan(docs).select(
        F.col("id").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_base"), F.array_min(F.col("hits.at")).alias("first_word"), F.array_max(F.col("hits.at")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("found.label"))), ",").alias("labels"),
        F.greatest(F.when(F.size("hits") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.col("found.containment")), F.lit(0.0))).alias("score"),
    )
