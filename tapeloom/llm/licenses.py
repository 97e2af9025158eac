"""Licence notices in texts: a positional index of rare licence words.

Templates are short notices. Document frequencies of their words are counted over the whole corpus; each template is
indexed under the rarest words of its mandatory phrase, with their places in it. A text's occurrences of indexed words
give, by relative position, where a template would start; templates whose words agree on a start are verified there:
the mandatory phrase must stand word for word, and the share of the template's words in place is the score. The phrase
gives the label, whatever else stands around it; only phrases of ``SHARED``, which other licences use too, need half of
their template in place, and a phrase that another one goes on from (attribution sharealike) gives way to it. Any text that holds a mandatory phrase holds its rarest words, so no notice is missed, and nothing is capped.

Cases: a null or empty text has no words and no labels. Rows with equal or null id are judged each by its own text. An
empty table gives an empty one. Ties of frequency are broken by the word. Other columns are not carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Rows, texts

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases that are always looked for, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, mandatory phrase, notice.
TEMPLATES = [
    ("agpl", "agplv3", "released under the agplv3"),
    ("agpl", "gnu affero general public license", "licensed under the gnu affero general public license version 3"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache", "apache 2 0", "spdx license identifier apache 2 0"),
    ("boost", "bsl 1 0", "spdx license identifier bsl 1 0"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or "
     "without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd 2 clause", "spdx license identifier bsd 2 clause"),
    ("bsd", "bsd 3 clause", "spdx license identifier bsd 3 clause"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under the creative commons attribution "
     "noncommercial 4 0 international license"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike", "licensed under the creative commons attribution sharealike 4 0 "
     "international license"),
    ("cc0", "cc0 1 0", "released under cc0 1 0 universal"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license 2 0"),
    ("epl", "epl 2 0", "spdx license identifier epl 2 0"),
    ("gpl", "gplv2", "released under the gplv2"),
    ("gpl", "gplv3", "released under the gplv3"),
    ("gpl", "identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl", "identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation"),
    ("isc", "identifier isc", "spdx license identifier isc"),
    ("isc", "isc license", "released under the isc license"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute "
     "this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "lgplv3", "released under the lgplv3"),
    ("lgpl", "identifier lgpl", "spdx license identifier lgpl 2 1"),
    ("mit", "identifier mit", "spdx license identifier mit"),
    ("mit", "mit x11", "released under the mit x11 license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining "
     "a copy of this software and associated documentation files"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mpl 2 0", "spdx license identifier mpl 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("zlib", "zlib license", "released under the zlib license"),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without "
     "any express or implied warranty in no event will the authors be held liable for any damages"),
]
RARE_WORDS = 2  # of a mandatory phrase, that a template is indexed under
# Phrases that do not tell the licence alone, and the share of the template's words in place that their label needs.
SHARED = frozenset(["in compliance with the license", "permission is hereby granted free of charge"])
LABEL_SCORE = 0.5
FOUND = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode().lower())


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many texts each template word occurs, and how many texts there are; tasks sum up before anything moves."""
    known = frozenset(w.encode() for _, _, t in TEMPLATES for w in t.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = dict.fromkeys(known, 0), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.column(0):
                for w in known.intersection(words_of(text.as_py())):
                    seen[w] += 1
        out = Rows("word string, n bigint")
        for w, n in [*seen.items(), (b"", rows)]:
            out.add(w.decode(), n)
        yield from out.take()

    sums = docs.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in sums.collect()}  # a row for each template word
    return found, found.pop(b"", 0)


class Index:
    """Templates by their rarest words, with what is needed to verify them."""

    def __init__(self, frequencies: dict[bytes, int], rows: int):
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.templates = []
        for n, (label, phrase, notice) in enumerate([(label, p, p) for p, label in BASE.items()] + TEMPLATES):
            words, must = notice.encode().split(), phrase.encode().split()
            at = next(i for i in range(len(words)) if words[i:i + len(must)] == must)
            self.templates.append((label, words, must, at, LABEL_SCORE if phrase in SHARED else 0.0))
            idf = {w: math.log((1 + rows) / (1 + frequencies.get(w, 0))) for w in must}
            for w in sorted(idf, key=lambda w: (-idf[w], w))[:RARE_WORDS]:
                self.postings.setdefault(w, []).extend((n, i) for i in range(at, at + len(must)) if words[i] == w)

    def scan(self, words: list[bytes]) -> tuple:
        places, base, labels, score = [], set(), set(), 0.0
        starts: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            if w in self.postings:
                starts.update((n, i - at) for n, at in self.postings[w])
        held: dict[int, tuple[int, list[str]]] = {}  # first word of a phrase -> its length, labels of the longest phrases there
        for n, s in starts:
            label, notice, must, at, least = self.templates[n]
            if s + at >= 0 and words[s + at:s + at + len(must)] == must:
                if n < len(BASE):
                    places.append(s)
                    base.add(label)
                    continue
                share = sum(s + i >= 0 and words[s + i:s + i + 1] == [x] for i, x in enumerate(notice)) / len(notice)
                score = max(score, share)
                if share >= least:
                    size, named = held.get(s + at, (0, []))
                    if len(must) >= size:  # a phrase that goes on names another licence
                        held[s + at] = len(must), [label, *(named if len(must) == size else [])]
        for _, named in held.values():
            labels.update(named)
        return places, base, labels, score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row."""
    frequencies, rows = document_frequencies(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = Index(frequencies, rows), Rows(FOUND)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                places, base, labels, score = index.scan(words)
                out.add(doc.as_py(), len(words), len(places), min(places, default=None), max(places, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | labels)), score, size=128)
            if out.full():
                yield from out.take()
        yield from out.take()

    return texts(docs, id_col, text_col).mapInArrow(run, FOUND)
