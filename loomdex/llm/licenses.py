"""Licence scan with a positional index of rare words.

Templates are short notices. The document frequency of every template word is counted over the
whole corpus; each template then posts its ``rare`` words of highest IDF with their positions. A file
looks up every posted word it has (at most templates x ``rare``), every meeting of a place in the file and a
posting votes for a relative position of a template, and a relative position with enough votes
is verified: the template's mandatory phrases must stand where it says, give or take ``SLACK`` words.

The phrases of ``BASE`` are found wherever their words stand consecutively, whatever the index says.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label, notice or passage of a licence's text, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("may not use this file except in compliance",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    # grants and conditions as whole licence texts have them
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("without restriction including without limitation the rights to use copy modify merge publish distribute sublicense",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work", ("perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "at your option any later version")),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom", ("take away your freedom to share and change", "gnu general public license")),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("origin of this software must not be misrepresented",)),
    ("mpl", "you may not use this file except in compliance with the mozilla public license exhibit a source code form license notice this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain",)),
)
SLACK = 3
#: Bytes of words as they are, A-Z lower-cased, blanks for all others.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


@dataclass(frozen=True)
class Index:
    """Postings of rare words: word -> ((template, position), ...)."""

    templates: tuple
    postings: dict[bytes, tuple[tuple[int, int], ...]]
    sizes: tuple[int, ...]  # posted words of each template


def template_words(templates=TEMPLATES) -> list[bytes]:
    return sorted({w for _, notice, _ in templates for w in notice.encode().split()})


def build_index(df: dict[bytes, int], n: int, rare: int = 8, templates=TEMPLATES) -> Index:
    """Post each template's ``rare`` words of highest IDF; ties by word."""
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in template_words(templates)}
    order = sorted(idf, key=lambda w: (-idf[w], w))
    rank = {w: i for i, w in enumerate(order)}
    postings: dict[bytes, list[tuple[int, int]]] = {}
    sizes = []
    for t, (_, notice, _) in enumerate(templates):
        words = notice.encode().split()
        chosen = set(sorted(set(words), key=rank.__getitem__)[:rare])
        sizes.append(len(chosen))
        for at, w in enumerate(words):
            if w in chosen:
                postings.setdefault(w, []).append((t, at))
    return Index(tuple(templates), {w: tuple(p) for w, p in postings.items()}, tuple(sizes))


def places(flat: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase starts in `` w w w ``; occurrences may overlap."""
    out, look = [], b" " + phrase + b" "
    at, seen, word = flat.find(look), 0, 0
    while at >= 0:
        word += flat.count(b" ", seen, at)
        out.append(word)
        seen = at
        at = flat.find(look, at + 1)
    return out


def match_templates(words: list[bytes], flat: bytes, index: Index, share: float = 0.6) -> dict[str, float]:
    """label -> share of a template's words in place, for verified templates."""
    have = index.postings.keys() & set(words)
    if not have:
        return {}
    starts: dict[int, list[np.ndarray]] = {}  # of a template: the starts each word votes for
    for w in have:
        here = np.array(places(flat, w))
        own: dict[int, list[np.ndarray]] = {}
        for t, at in index.postings[w]:
            own.setdefault(t, []).append(here - at)
        for t, votes in own.items():
            starts.setdefault(t, []).append(np.unique(np.concatenate(votes)))
    found: dict[str, float] = {}
    phrases: dict[str, list[int]] = {}
    for t, votes in starts.items():
        need = max(2, math.ceil(share * index.sizes[t]))
        if len(votes) < need:
            continue
        start, got = np.unique(np.concatenate(votes), return_counts=True)
        for at in start[got >= need].tolist():
            verify(words, flat, index.templates[t], at, phrases, found)
    return found


def verify(words: list[bytes], flat: bytes, template: tuple, start: int, phrases: dict, found: dict[str, float]) -> None:
    """Add the template's label to ``found`` if its mandatory phrases stand where ``start`` says."""
    label, notice, mandatory = template
    for phrase in mandatory:
        if phrase not in phrases:
            phrases[phrase] = places(flat, phrase.encode())  # in rising order
        own = start + notice[: notice.index(phrase)].count(" ")
        near = bisect_left(phrases[phrase], own - SLACK)
        if near == len(phrases[phrase]) or phrases[phrase][near] > own + SLACK:
            return
    own = notice.encode().split()
    hits = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(own))
    found[label] = max(found.get(label, 0.0), hits / len(own))


def scan(text: bytes | None, index: Index) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    flat = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in BASE:
        got = places(flat, phrase.encode())
        if got:
            starts += got
            base.add(label)
    more = match_templates(words, flat, index)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | more.keys())), max(more.values(), default=0.0),
    )


def document_frequencies(documents: DataFrame, vocabulary: list[bytes]) -> tuple[dict[bytes, int], int]:
    """How many texts have each word, and how many texts there are. The result has a row per template word at most."""
    wanted = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                total.update(wanted.intersection(words_of(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    counts = documents.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "w binary, n long")
    got = counts.groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in got}, documents.count()


def scan_licenses(documents: DataFrame, rare: int = 8, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    score is the best share of a verified template's words in place, 0 without one. Null and empty texts have
    no words, empty labels and null places. Repeated rows are scanned alike, extra columns are ignored,
    an empty table gives an empty result.
    """
    df, n = document_frequencies(documents, template_words(templates))
    index = build_index(df, n, rare, templates)  # bounded by the templates
    kind = documents.schema["doc_id"].dataType.simpleString()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(x.as_py(), index) for x in b.column(1)]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return documents.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
