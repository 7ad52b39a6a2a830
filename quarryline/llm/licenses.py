"""Licence scan by a positional rare-token index, with native expressions.

Licence templates are cut into words.  A file is cut into words once; what is kept
of it are the places of the words that some template has.  From these come the
document frequencies, and by them the words of each template that are rarest over all
documents, its anchors (highest inverse document frequency).  A file's anchor
words are looked up in the postings (template, position); a template that stands in
the file puts its anchors at one relative position, so hits are added up by
(template, file position - template position).  A template whose aligned weight is
high enough is verified by its mandatory key phrases, which are runs of kept words.

Everything but the document frequencies of the few hundred template words is
local to a row, so neither long files nor frequent words make a shuffle uneven.
Three fixed phrases give the base labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import PLAIN_WORD, ascii_lower, let

#: Base phrases, by last word first found, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


#: Short public licence notices, with the phrases that must stand in a file.
TEMPLATES = (
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("apache-2.0-notice", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0-notice", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("cc-by-nc-4.0-notice", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0-notice", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc0-1.0-notice", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "sublicense and or sell copies"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("except in compliance with the license",),
    ),
    Template(
        "gpl-3.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "either version 3 of the license"),
    ),
    Template(
        "lgpl-2.1-or-later",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms",),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "agpl-3.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license", "either version 3 of the license"),
    ),
    Template(
        "gpl-2.0-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "either version 2 of the license"),
    ),
    Template(
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products derived from this software",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("alter it and redistribute it freely",),
    ),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ("accompanying documentation covered by this license",),
    ),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
_FOUND = "array<struct<label:string,share:double>>"


def plain_word_array(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


@dataclass(frozen=True)
class LicenseIndex:
    """Anchor postings: word to (template, position, weight), and the templates' whole weights."""

    postings: dict[str, tuple[tuple[int, int, float], ...]]
    weights: tuple[float, ...]
    templates: tuple[Template, ...]


def licence_words(docs: DataFrame, *, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, out: str = "licence_words") -> DataFrame:
    """Adds the struct ``out``: n_words, places (base phrases) and hits (word, place) of the templates' words."""
    words = sorted({w for t in templates for w in t.text.split()} | {w for t in templates for p in t.phrases for w in p.split()})

    def marked(w):
        hits = F.transform(w, lambda x, i: F.when(x.isin(words), F.struct(x.alias("w"), i.alias("i"))))
        return F.struct(F.size(w).cast("long").alias("n_words"), base_places(w).alias("places"), F.filter(hits, lambda x: x.isNotNull()).alias("hits"))

    return docs.withColumn(out, let(plain_word_array(F.col(text_col)), marked))


def build_index(docs: DataFrame, *, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, anchors: int = 12) -> LicenseIndex:
    """Picks each template's rarest words by their frequency over all documents."""
    marked = licence_words(docs.select(F.col(text_col).alias("text")), templates=templates)
    return index_of(marked, templates=templates, anchors=anchors)


def index_of(marked: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, anchors: int = 12, words: str = "licence_words") -> LicenseIndex:
    """The same from ``licence_words``.

    One aggregation; what comes to the driver is a count per word of the
    templates.  Over an empty table all words weigh the same.
    """
    present = F.array_distinct(F.transform(F.col(words)["hits"], lambda h: h["w"]))
    seen = marked.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in seen}
    total = df.get("", 0)
    idf = {w: float(_ln((total + 1) / (df.get(w, 0) + 1))) + 0.01 for t in templates for w in t.text.split()}
    postings: dict[str, list[tuple[int, int, float]]] = {}
    weights = []
    for t, template in enumerate(templates):
        own = template.text.split()
        rare = sorted(set(own), key=lambda w: (-idf[w], w))[:anchors]
        weights.append(sum(idf[w] for w in own if w in rare))
        for i, w in enumerate(own):
            if w in rare:
                postings.setdefault(w, []).append((t, i, idf[w]))
    return LicenseIndex({w: tuple(p) for w, p in sorted(postings.items())}, tuple(weights), templates)


def _ln(x: float) -> float:
    from math import log

    return log(x)


def base_places(words: Column) -> Column:
    """(first word, label) of every place of a base phrase, by place."""

    def place(w, i):
        before = lambda k: F.get(words, i - k)
        at = lambda k, label: F.struct((i - k).cast("long").alias("at"), F.lit(label).alias("label"))
        return F.when(w == "license", F.when(before(1) == "mit", at(1, "mit")).when(before(1) == "apache", at(1, "apache")).when((before(1) == "public") & (before(2) == "general"), at(2, "gpl")))

    return F.filter(F.transform(words, place), lambda x: x.isNotNull())


def template_hits(words: Column, index: LicenseIndex, share: float) -> Column:
    """Verified templates among a text's licence words (w, i), with the aligned share of their anchor weight."""
    anchors = list(index.postings)
    hits = F.filter(words, lambda h: h["w"].isin(anchors))
    posting = lambda p: F.struct(F.lit(p[0]).alias("t"), F.lit(p[1]).alias("pos"), F.lit(p[2] / index.weights[p[0]]).alias("share"))
    table = F.create_map(*(x for w, ps in index.postings.items() for x in (F.lit(w), F.array(*map(posting, ps)))))

    def align(h):
        aligned = F.sort_array(F.flatten(F.transform(h, lambda x: F.transform(F.element_at(table, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["pos"]).alias("d"), p["share"].alias("share"))))))
        zero = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("d"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<t:int,share:double>>").alias("found"))

        def step(acc, x):
            same = (acc["t"] == x["t"]) & (acc["d"] == x["d"])
            total = F.when(same, acc["sum"]).otherwise(F.lit(0.0)) + x["share"]
            # Alignments come by template: the best of the one at hand is the last found, so no more are kept than templates.
            last = F.try_element_at(acc["found"], F.lit(-1))
            again = F.coalesce(last["t"] == x["t"], F.lit(False))
            rest = F.when(again, F.slice(acc["found"], F.lit(1), F.size(acc["found"]) - 1)).otherwise(acc["found"])
            best = F.greatest(F.least(total, F.lit(1.0)), F.when(again, last["share"]).otherwise(F.lit(0.0)))
            found = F.when(total >= share, F.concat(rest, F.array(F.struct(x["t"].alias("t"), best.alias("share"))))).otherwise(acc["found"])
            return F.struct(x["t"].alias("t"), x["d"].alias("d"), total.alias("sum"), found.alias("found"))

        return F.aggregate(aligned, zero, step, lambda acc: acc["found"])

    def verify(found):
        # Words that do not follow one another have a bar between them, so a phrase stands only where its words do.
        follows = lambda h, k: F.coalesce(F.get(words, k - 1)["i"] == h["i"] - 1, F.lit(True))
        runs = F.transform(words, lambda h, k: F.when(follows(h, k), h["w"]).otherwise(F.concat(F.lit("| "), h["w"])))
        line = F.concat(F.lit(" "), F.array_join(runs, " "), F.lit(" "))

        def checked(s):
            out = []
            for t, template in enumerate(index.templates):
                best = F.array_max(F.transform(F.filter(found, lambda x: x["t"] == t), lambda x: x["share"]))
                ok = best.isNotNull()
                for p in template.phrases:
                    ok = ok & s.contains(f" {p} ")
                out.append(F.when(ok, F.struct(F.lit(template.label).alias("label"), best.alias("share"))))
            return F.filter(F.array(*out), lambda x: x.isNotNull()).cast(_FOUND)

        return F.when(F.size(found) > 0, let(line, checked)).otherwise(F.array().cast(_FOUND))

    each = lambda h: F.when(F.size(h) > 0, let(align(h), verify)).otherwise(F.array().cast(_FOUND))
    return let(hits, each)


def matched(marked: DataFrame, index: LicenseIndex, *, words: str = "licence_words", share: float = 0.7, out: str = "licenses") -> DataFrame:
    """``licence_words`` to the struct ``out``: n_words, places (base phrases) and templates (verified)."""
    w = F.col(words)
    one = F.struct(w["n_words"].alias("n_words"), w["places"].alias("places"), template_hits(w["hits"], index, share).alias("templates"))
    return marked.withColumn(out, one).drop(*({words} - {out}))


def scan_licenses(docs: DataFrame, index: LicenseIndex, *, text_col: str = "text", share: float = 0.7, out: str = "licenses") -> DataFrame:
    """Adds the struct ``out``: n_words, places (base phrases) and templates (verified).

    Null texts count as empty.  A file may hold several licences, each any number
    of times.  Repeated rows get equal results; a column of the name ``out`` is
    replaced, others stay.
    """
    marked = licence_words(docs, text_col=text_col, templates=index.templates, out=out)
    return matched(marked, index, words=out, share=share, out=out)
