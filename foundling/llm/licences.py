"""Licence scan with a positional index of rare words.  DataFrame functions only.

The index holds the distinctive words of short licence notices with their places.  Per notice the ``ANCHORS`` places of
its mandatory phrases whose words have the highest inverse document frequency are looked up in every file; a place in a
notice, subtracted from the place in the file, says where the notice would start.  Where at least two agree on a start, the
notice's mandatory phrases are compared word by word.  As anchors lie in mandatory phrases, no notice whose phrases are
there is missed, whatever else the file holds.  Document frequencies are counted over all files; one number per indexed
word is what the driver reads.

Besides, every place of the base phrases is counted.

Defined results: null is an empty text: no words, no labels, score 0; repeated rows get equal results; extra columns pass
through the struct ``row``; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

#: Runs of letters, digits and signs outside ASCII; the same runs as in the lower-cased text.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed by contract: phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public licence notices: label, wording, mandatory phrases.
NOTICES = (
    ("mit", "Released under the MIT License", ("released under the mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "copy of this software")),
    ("apache", "Licensed under the Apache License, Version 2.0", ("licensed under the apache license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
     ("terms of the gnu general public license",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ("for any purpose with or without fee is hereby granted",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
)
#: Words too common to be indexed.
COMMON = frozenset("a an and any are as at be by for from in is it its of on or that the this to under use was with without".split())
ANCHORS = 3
AGREE = 2


def tokens(text: str) -> list[str]:
    return [w.lower() for w in re.findall(TOKEN, text)]


def _index() -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (notice, place) of each indexed word, and the number of indexed places of each notice."""
    postings: dict[str, list[tuple[int, int]]] = {}
    places = [0] * len(NOTICES)
    for t, (_, wording, _) in enumerate(NOTICES):
        for p, w in enumerate(tokens(wording)):
            if w not in COMMON:
                postings.setdefault(w, []).append((t, p))
                places[t] += 1
    return postings, places


POSTINGS, PLACES = _index()


def anchored(idf: dict[str, float], anchors: int) -> dict[str, list[tuple[int, int]]]:
    """Postings of the anchors: of each notice the places in mandatory phrases whose words are rarest."""
    chosen: dict[str, list[tuple[int, int]]] = {}
    for t, (_, wording, must) in enumerate(NOTICES):
        words = tokens(wording)
        inside = {_place(wording, phrase) + d for phrase in must for d in range(len(phrase.split()))}
        for p in sorted((p for p in inside if words[p] not in COMMON), key=lambda p: (-idf[words[p]], p))[:anchors]:
            chosen.setdefault(words[p], []).append((t, p))
    return chosen


VOCABULARY = sorted(set(POSTINGS) | {w for phrase, _ in BASE for w in phrase.split()})


def _found(docs: DataFrame, text: str) -> DataFrame:
    """``words`` of each row, and ``known``: place and word of those in the vocabulary."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(True).alias("_")).alias("row")
    words = docs.select(row, F.coalesce(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")).alias("words"))

    def look(w: Column, i: Column) -> Column:
        # signs outside ASCII whose lower case is a letter of it stay what they are
        plain = (F.octet_length(w) <= 14) & F.lower(w).isin(*VOCABULARY) & (F.octet_length(w) == F.char_length(w))
        return F.when(plain, F.struct(i.alias("i"), F.lower(w).alias("w")))

    return words.withColumn("known", F.filter(F.transform("words", look), lambda x: x.isNotNull()))


def frequencies(docs: DataFrame, *, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each vocabulary word."""
    held = _found(docs, text).select(F.explode(F.array_union(F.array_distinct(F.transform("known", lambda x: x["w"])), F.array(F.lit("")))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per vocabulary word
    return counts.pop("", 0), counts


def _starts(known: Column) -> Column:
    """(place, label) of every base phrase."""
    def at(x: Column, k: Column) -> Column:
        case = None
        for phrase, label in BASE:
            own = phrase.split()
            hit = x["w"] == own[0]
            for d, w in enumerate(own[1:], 1):
                there = F.get(known, k + d)
                hit = hit & (there["w"] == w) & (there["i"] == x["i"] + d)
            value = F.struct(x["i"].alias("i"), F.lit(label).alias("label"))
            case = F.when(hit, value) if case is None else case.when(hit, value)
        return case

    return F.filter(F.transform(known, at), lambda x: x.isNotNull())


def _map(pairs: dict, value) -> Column:
    return F.create_map(*[x for k, v in sorted(pairs.items()) for x in (F.lit(k), value(v))])


def scan(docs: DataFrame, *, text: str = "text", anchors: int = ANCHORS, agree: int = AGREE) -> DataFrame:
    """Each row's other columns as ``row``, with n_words, n_base, first_word, last_word, base_labels, labels, score and
    ``notices``: label, first word and share of indexed words for each verified notice."""
    total, held = frequencies(docs, text=text)
    idf = {w: math.log((total + 1) / (held.get(w, 0) + 1)) for w in POSTINGS}
    rare = anchored(idf, max(anchors, agree))
    known = F.col("known")
    based = _found(docs, text).withColumn("base", _starts(known))

    def hits(index: dict) -> Column:
        postings = _map(index, lambda v: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in v]))
        return F.flatten(F.transform(
            F.filter(known, lambda x: x["w"].isin(*index)),
            lambda x: F.transform(F.element_at(postings, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("o"))),
        ))

    meet = based.withColumn("hits", F.when(F.size(known) > 0, F.array_sort(hits(rare))))
    # the first of `agree` or more equal neighbours
    crossing = F.filter(F.transform("hits", lambda x, k: F.when(
        (F.get(F.col("hits"), k + (agree - 1)) == x) & ((k == 0) | (F.get(F.col("hits"), k - 1) != x)), x,
    )), lambda x: x.isNotNull())
    meet = meet.withColumn("crossing", crossing)
    places = F.array(*[F.lit(n) for n in PLACES])
    phrases = F.array(*[
        F.array(*[F.struct(F.lit(_place(wording, phrase)).alias("p"), F.lit(len(phrase.split())).alias("n"), F.lit(phrase).alias("s")) for phrase in must])
        for _, wording, must in NOTICES
    ])
    labels = F.array(*[F.lit(label) for label, _, _ in NOTICES])

    def said(x: Column) -> Column:
        def one(m: Column) -> Column:
            at = x["o"] + m["p"]
            own = F.concat_ws(" ", F.slice("words", F.greatest(at + 1, F.lit(1)), m["n"]))
            return (at >= 0) & (F.lower(own) == m["s"]) & (F.octet_length(own) == F.char_length(own))

        return F.forall(F.get(phrases, x["t"]), one)

    def described(x: Column) -> Column:
        same = F.size(F.filter("every", lambda y: y == x))
        return F.struct(F.get(labels, x["t"]).alias("label"), F.greatest(x["o"], F.lit(0)).cast("long").alias("first_word"), (same / F.get(places, x["t"])).alias("share"))

    verified = meet.withColumn("sure", F.filter("crossing", said))
    verified = verified.withColumn("every", F.when(F.size("sure") > 0, hits(POSTINGS)))
    verified = verified.withColumn("notices", F.coalesce(F.when(F.size("sure") > 0, F.transform("sure", described)), F.array().cast("array<struct<label:string,first_word:bigint,share:double>>")))
    own = F.transform("base", lambda x: x["label"])
    places_of = F.transform("base", lambda x: x["i"].cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.array_max(F.transform("notices", lambda x: x["share"]))
    return verified.select(
        "row", F.size("words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(places_of).alias("first_word"), F.array_max(places_of).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, F.transform("notices", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("notices") > 0, 0.5 + 0.5 * F.least(best, F.lit(1.0))).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"), "notices",
    )


def _place(wording: str, phrase: str) -> int:
    words, own = tokens(wording), phrase.split()
    return next(i for i in range(len(words)) if words[i:i + len(own)] == own)
