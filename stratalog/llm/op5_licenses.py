"""License scans with a positional index of rare words.

The index holds fixed templates of license texts: for each of their words, the templates and positions it stands at. A document's words that
any template has are its hits. A template's label needs a key phrase of the template, word by word: each place where one stands, found from its
rarest word, sets a start of the template, and every word of the template that the document has where that start puts it votes with its inverse
document frequency. The label is given where the votes for one start reach ``LEAST`` of the sum over the template's words. Starts without a key
phrase in place can't give a label, so none is left out. Document frequencies are counted over the whole corpus; words that nearly all documents
have keep the weight ``FLOOR``. The score is the best such share.

Base labels come from three plain phrases anywhere in the text and always stay. Nulls count as empty texts, without words or labels. Texts of any length
are scanned in one pass over their hits. Repeated rows are scanned each on its own, though the frequencies count both; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, staged, table

FLOOR = 0.01
LEAST = 0.5
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: By label: notices and openings of license texts, and the phrases of which one must stand in its place.
TEMPLATES: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "mit": [
        ("released under the mit license", ("mit license",)),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ],
    "apache": [
        ("licensed under the apache license version 2 0", ("apache license",)),
        ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    ],
    "gpl": [
        ("this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published",)),
    ],
    "lgpl": [("licensed under the gnu lesser general public license", ("gnu lesser general public license",))],
    "agpl": [("licensed under the gnu affero general public license", ("gnu affero general public license",))],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",))],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",))],
    "mpl": [("this source code form is subject to the terms of the mozilla public license", ("mozilla public license",))],
    "cc-by-nc": [
        ("licensed under cc by nc 4 0", ("cc by nc",)),
        ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ],
    "cc-by": [("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",))],
    "unlicense": [("this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",))],
}
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_VOCABULARY = sorted({w for group in TEMPLATES.values() for text, _ in group for w in text.split()} | {w for p in BASE for w in p.split()})


def hits(docs: DataFrame) -> DataFrame:
    """n_words, and the words of a document that the templates have: the word and its place, ascending."""

    def found(words: Column) -> Column:
        skip = F.when(words[0] == "", 1).otherwise(0)
        last = F.when(F.element_at(words, -1) == "", 1).otherwise(0)
        n = F.when((F.size(words) == 1) & (words[0] == ""), 0).otherwise(F.size(words) - skip - last)
        at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(_VOCABULARY), F.struct(w.alias("w"), (i - skip).alias("p")))))
        return F.struct(n.cast("long").alias("n_words"), at.alias("hits"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # but for two letters, lower-casing the others as well makes no other ASCII words
    text = F.when(text.rlike("[\u0130\u212A]"), F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(F.split(text, _SPLIT), found).alias("f")).select("doc_id", "f.*")


def _stands(at: Column, words: list[str], start: Column) -> Column:
    """Whether ``words`` stand from place ``start`` on."""
    out = F.lit(True)
    for i, w in enumerate(words):
        out = out & F.array_contains(at, F.struct(F.lit(w).alias("w"), (start + i).cast("int").alias("p")))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Base places and labels of each document, and those that the index adds."""
    rows = staged(hits(docs), "hits")
    total = rows.count()
    seen = rows.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # at most the templates' words
    idf = {r.w: max(FLOOR, math.log((total + 1) / (r.n + 1))) for r in seen}

    def share(at: Column, text: str, keys: tuple[str, ...]) -> Column:
        """The best share of the template's weights at one start that has a key phrase in place."""
        words = text.split()
        whole = reduce(add, [idf[w] for w in words if w in idf], 0.0)  # in the order of the votes, so that a whole notice has 1
        phrases = [(k, p.split()) for p in keys for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        phrases = [(k, p) for k, p in phrases if all(w in idf for w in p)]
        if not phrases:
            return F.lit(0.0)

        def at_start(near: Column, start: Column) -> Column:
            got = F.lit(0.0)
            for k, w in enumerate(words):
                if w in idf:
                    got = got + F.when(_stands(near, [w], start + k), idf[w]).otherwise(0.0)
            return let(got / whole, lambda g: F.when(g >= LEAST, F.least(g, F.lit(1.0))).otherwise(0.0))

        def best(k: int, phrase: list[str]) -> Column:
            rarest = max(range(len(phrase)), key=lambda i: idf[phrase[i]])
            marks = F.filter(F.transform(at, lambda h, i: F.struct(h["w"].alias("w"), h["p"].alias("p"), i.alias("i"))), lambda m: m["w"] == phrase[rarest])
            # the template's other words are among the hits next to the mark, which are ascending and one a place
            near = lambda m: F.slice(at, F.greatest(m["i"] + 1 - len(words), F.lit(1)), F.lit(2 * len(words)))
            found = lambda m: let(near(m), lambda x: F.when(_stands(x, phrase, m["p"] - rarest), at_start(x, m["p"] - rarest - k)).otherwise(0.0))
            return F.coalesce(F.array_max(F.transform(marks, found)), F.lit(0.0))

        return F.greatest(*[best(*x) for x in phrases], F.lit(0.0))

    def places(at: Column, words: list[str]) -> Column:
        # words that stand one after the other are hits one after the other
        follows = lambda h, i: reduce(and_, [F.coalesce((F.get(at, i + k)["w"] == w) & (F.get(at, i + k)["p"] == h["p"] + k), F.lit(False)) for k, w in enumerate(words[1:], 1)], h["w"] == words[0])
        return F.transform(F.filter(at, follows), lambda h: h["p"])

    def judged(at: Column) -> Column:
        starts = {p: places(at, p.split()) for p in BASE}
        labels = sorted(TEMPLATES)
        none = F.array(*[F.lit(0.0)] * len(labels))
        by_label = F.when(F.size(at) == 0, none).otherwise(F.array(*[F.greatest(*[share(at, *t) for t in TEMPLATES[x]], F.lit(0.0)) for x in labels]))
        return F.struct(
            F.concat(*starts.values()).alias("places"),
            F.array_compact(F.array(*[F.when(F.size(v) > 0, F.lit(BASE[p])) for p, v in starts.items()])).alias("base"),
            by_label.alias("scores"),
        )

    out = rows.select("doc_id", "n_words", let(F.col("hits"), judged).alias("j")).select("doc_id", "n_words", "j.*")
    own = F.array_compact(F.array(*[F.when(F.col("scores")[i] > 0, F.lit(x)) for i, x in enumerate(sorted(TEMPLATES))]))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", own)), ",").alias("labels"),
        F.array_max("scores").alias("score"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
