"""Licence scans by a positional index of rare words.

How many documents hold a licence word is counted over the whole table. Every template is indexed under the rarest
words of its key phrases: a word's posting is a template and the word's position in it. In a document each such word
votes for the place where the template would start; places that all of them agree on are candidates, and a candidate
counts if the template's key phrases stand there word for word. As these words are part of what must stand there, no
place is missed. A phrase is a template that is all key phrase.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C

# So many of the rarest words of a template's key phrases must agree on a place.
RARE = 3


@dataclass(frozen=True)
class Template:
    """Words of a licence and the phrases in it without which it does not count."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        found = []
        for key in self.keys:
            words = key.split()
            places = [i for i in range(len(self.words)) if self.words[i : i + len(words)] == words]
            if not places:
                raise ValueError(f"{self.label}: no place of {key!r}")
            found.append((places[0], words))
        return found


def phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,))


# Phrases that name a licence, and its label.
PHRASES = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
)

# Well-known sentences of licences, in the words they are made of.
TEMPLATES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license",
        ("apache license version 2", "except in compliance with the license"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("for any purpose with or without fee",),
    ),
    Template(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation",
        ("gnu general public license",),
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "cc-by",
        "this work is licensed under the creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
)


class Vocabulary:
    """The licence words, and their numbers in a text."""

    def __init__(self, words: list[str]):
        text = [w.encode() for w in sorted(set(words))]
        data = np.frombuffer(b"".join(text), np.uint8)
        ends = np.cumsum([len(w) for w in text])
        hashes = C.byte_spans(data).hashes(ends - np.array([len(w) for w in text]), ends)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [text[i] for i in order]
        self.numbers = {w.decode(): i for i, w in enumerate(self.words)}

    def read(self, data, offsets):
        """Numbers of all words of the rows, -1 for other words, with their rows and bytes."""
        low = C.LOWER[data]
        starts, ends, rows = C.word_spans(low, offsets, C.ALNUM)
        hashes = C.byte_spans(low).hashes(starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        numbers = np.where(self.hashes[place] == hashes, place, -1)
        return numbers, rows, (low, starts, ends)

    def same(self, spelled, first: int, numbers) -> bool:
        """Whether the words from ``first`` on are spelled like the numbered ones, which their hashes only suggest."""
        low, starts, ends = spelled
        return all(low[starts[first + i] : ends[first + i]].tobytes() == self.words[n] for i, n in enumerate(numbers))


def _frequencies(vocabulary: Vocabulary):
    def run(batches):
        found = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch, data, offsets in C.slices(batches):
            numbers, rows, _ = vocabulary.read(data, offsets)
            known = numbers >= 0
            pairs = np.unique(rows[known] * len(found) + numbers[known])
            found += np.bincount(pairs % len(found), minlength=len(found))
            found[-1] += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int32()), pa.array(found)], ["word", "n"])

    return run


def _index(templates, vocabulary: Vocabulary, rarity: np.ndarray):
    """For each template: its word numbers, (position, number) of its rarest key words, and its key phrases."""
    out = []
    for t in templates:
        numbers = [vocabulary.numbers[w] for w in t.words]
        keys = [(place, [vocabulary.numbers[w] for w in words]) for place, words in t.key_places()]
        places = {place + i for place, words in keys for i in range(len(words))}
        ranked = sorted(places, key=lambda i: (-rarity[numbers[i]], i))[:RARE]
        out.append((t.label, np.array(numbers), [(i, numbers[i]) for i in ranked], keys))
    return out


def _scan(vocabulary, index, phrases: int):
    def run(batches):
        for batch, data, offsets in C.slices(batches):
            numbers, rows, spelled = vocabulary.read(data, offsets)
            counts = np.bincount(rows, minlength=len(batch))
            first = np.cumsum(counts) - counts
            found = [[] for _ in counts]
            for t, (label, words, rare, keys) in enumerate(index):
                votes = np.concatenate([np.flatnonzero(numbers == n) - i for i, n in rare])
                starts, agree = np.unique(votes, return_counts=True)
                starts = starts[agree == len(rare)]
                end = max(place + len(key) for place, key in keys)
                begin = min(place for place, _ in keys)
                starts = starts[(starts + begin >= 0) & (starts + end <= len(numbers))]
                starts = starts[rows[starts + begin] == rows[starts + end - 1]]
                for place, key in keys:
                    for i, n in enumerate(key):
                        starts = starts[numbers[starts + place + i] == n]
                for s in starts.tolist():
                    if not all(vocabulary.same(spelled, s + place, key) for place, key in keys):
                        continue
                    row = int(rows[s + begin])
                    a, b = max(s, int(first[row])), min(s + len(words), int(first[row] + counts[row]))
                    share = float((numbers[a:b] == words[a - s : b - s]).sum()) / len(words)
                    found[row].append((t < phrases, label, s + begin - int(first[row]), end - begin, share))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _FOUND)], ["doc_id", "n_words", "found"]
            )

    return run


_FOUND = pa.list_(
    pa.struct([("base", pa.bool_()), ("label", pa.string()), ("start", pa.int64()), ("size", pa.int32()), ("share", pa.float64())])
)


def scanned(
    docs: DataFrame,
    phrases: tuple[Template, ...] = PHRASES,
    templates: tuple[Template, ...] = TEMPLATES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels (array), labels
    (array), score, places (array)``.

    ``n_base`` counts all places of the phrases, overlapping ones too. ``labels`` adds those of templates whose key
    phrases stand in their places; ``score`` is the largest share of a template's words found in place, 1 for a phrase,
    0 without a label. A null text has no words; repeated rows are judged each; no rows in, no rows out.
    """
    spark = docs.sparkSession
    source = C.texts(docs, id_column, text_column)
    every = [*phrases, *templates]
    vocabulary = Vocabulary([w for t in every for w in t.words])
    counts = source.mapInArrow(_frequencies(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = np.zeros(len(vocabulary.words) + 1)
    for r in counts.collect():
        found[r["word"]] = r["n"]
    rarity = np.array([log((found[-1] + 1) / (n + 1)) for n in found[:-1]])
    schema = f"""doc_id {dict(source.dtypes)["doc_id"]}, n_words long,
        found array<struct<base:boolean,label:string,start:long,size:int,share:double>>"""
    seen = source.mapInArrow(_scan(vocabulary, _index(every, vocabulary, rarity), len(phrases)), schema)
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    return seen.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))).alias("base_labels"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.col("found").alias("places"),
    )
