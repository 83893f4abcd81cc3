"""License scans with a generalised suffix automaton of licence words.

The automaton holds the words of all templates and phrases. A document is
streamed through it once: at each word it knows, for every template, the longest
run of words that ends there and stands in it (the matching statistics), and all
places where it does. Runs that can't grow any more are chained, in order in
both texts, into spans of their template; the best chain that covers enough of a
template labels the document. Phrases are found wherever the whole phrase ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Phrases that always give their label.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices of public licences.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Licensed under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced"),
)

#: Words of a match that may be chained, words between two matches of a chain, and the share of a template that a span must cover.
MIN_MATCH = 3
MAX_GAP = 20
MIN_COVER = 0.8

#: Characters of a table of templates: some two thousand whole licences.
MAX_TEMPLATE_CHARS = 20_000_000

_WORD_BYTES = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """The words [0-9a-z and above U+007F] of a text in UTF-8, A-Z lower-cased."""
    return raw.translate(_WORD_BYTES).split()


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: Template -> the places in it after the occurrences of this state's runs.
    ends: dict[int, list[int]] = field(default_factory=dict)
    #: Template that only shorter runs stand in -> the state of the longest of those.
    shorter: dict[int, int] = field(default_factory=dict)
    #: Phrases that end wherever this state is reached, by (words, number).
    phrases: tuple[tuple[int, int], ...] = ()


class Automaton:
    """A suffix automaton of several word sequences; states are extended by one word at a time and split where runs part."""

    def __init__(self, phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]):
        self.phrases, self.templates = phrases, templates
        self.vocabulary: dict[bytes, int] = {}
        self.states = [State(0)]
        texts = [words_of(text.encode()) for text, _ in phrases] + [words_of(text.encode()) for _, text in templates]
        self.sizes = [len(t) for t in texts]
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in texts]
        for number, ids in enumerate(self.sequences):
            last = 0
            for place, word in enumerate(ids, 1):
                last = self._extend(last, word)
                self.states[last].ends.setdefault(number, []).append(place)
        self._close()
        #: Templates of too few words for a match: they are looked for as they stand.
        self.short = [(k, np.array(ids) + 1) for k, ids in enumerate(self.sequences) if k >= len(phrases) and 0 < len(ids) < MIN_MATCH]
        #: Pairs of words that follow each other in a template, as sorted numbers; word 0 is one of no template.
        width = np.int64(len(self.vocabulary) + 1)
        self._pairs = np.unique(np.array([(a + 1) * width + b + 1 for ids in self.sequences for a, b in zip(ids, ids[1:])], dtype=np.int64))

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether two words in a row stand so in a template."""
        if not len(self._pairs):
            return np.zeros(len(first), dtype=bool)
        asked = first * np.int64(len(self.vocabulary) + 1) + second
        return self._pairs[np.minimum(np.searchsorted(self._pairs, asked), len(self._pairs) - 1)] == asked

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        if word in states[last].next:
            q = states[last].next[word]
            return q if states[q].length == states[last].length + 1 else self._split(last, word, q)
        new = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at != -1 and word not in states[at].next:
            states[at].next[word] = new
            at = states[at].link
        if at == -1:
            states[new].link = 0
        else:
            q = states[at].next[word]
            states[new].link = q if states[q].length == states[at].length + 1 else self._split(at, word, q)
        return new

    def _split(self, at: int, word: int, q: int) -> int:
        states = self.states
        short = len(states)
        states.append(State(states[at].length + 1, states[q].link, dict(states[q].next)))
        while at != -1 and states[at].next.get(word) == q:
            states[at].next[word] = short
            at = states[at].link
        states[q].link = short
        return short

    def _close(self) -> None:
        """Occurrences go from the longer states to their suffixes, phrases from the suffixes to the longer states."""
        order = sorted(range(1, len(self.states)), key=lambda k: self.states[k].length)
        for k in reversed(order):
            up = self.states[self.states[k].link]
            for number, places in self.states[k].ends.items():
                up.ends.setdefault(number, []).extend(places)
        own: dict[int, list[tuple[int, int]]] = {}
        for number in range(len(self.phrases)):
            at = 0
            for word in self.sequences[number]:
                at = self.states[at].next[word]
            own.setdefault(at, []).append((self.sizes[number], number))
        for k in order:
            up = self.states[self.states[k].link]
            near = {number: self.states[k].link for number in up.ends} if up.length >= MIN_MATCH else {}
            self.states[k].shorter = {number: at for number, at in {**up.shorter, **near}.items() if number not in self.states[k].ends}
            self.states[k].phrases = (*own.get(k, ()), *self.states[self.states[k].link].phrases)

    def scan(self, raw: bytes | None) -> tuple[int, dict[int, list[int]], dict[int, float]]:
        """(words, starts of each phrase, best cover of each template that a span covers)."""
        words = words_of(raw) if raw else []
        if len(words) < 2 and not (words and self.short):
            return len(words), {}, {}
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words)) + 1
        known = self.pairs(ids[:-1], ids[1:])
        edges = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        found: dict[int, list[int]] = {}
        matches: dict[int, list[tuple[int, int, list[int]]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            self._walk((ids[a : b + 1] - 1).tolist(), a, found, matches)
        covers = {number: self._chain(runs) / self.sizes[number] for number, runs in matches.items()}
        for number, wanted in self.short:
            starts = len(ids) - len(wanted) + 1
            if starts > 0 and np.all([ids[k : k + starts] == word for k, word in enumerate(wanted)], axis=0).any():
                covers[number] = 1.0
        return len(words), found, {number: share for number, share in covers.items() if share >= MIN_COVER}

    def _walk(self, ids: list[int], start: int, found: dict[int, list[int]], matches: dict[int, list[tuple[int, int, list[int]]]]) -> None:
        """Matching statistics of a run of words; a template's match (start, words, places after it) is noted where it can't grow any more."""
        states, first = self.states, len(self.phrases)
        at = length = 0
        held: dict[int, tuple[int, int]] = {}

        def note(runs: dict[int, tuple[int, int]], stop: int) -> None:
            for number, (n, state) in runs.items():
                if n >= min(MIN_MATCH, self.sizes[number]):
                    matches.setdefault(number, []).append((stop - n, n, states[state].ends[number]))

        for place, word in enumerate(ids, start):
            while at and word not in states[at].next:
                at = states[at].link
                length = states[at].length
            if word in states[at].next:
                at = states[at].next[word]
                length += 1
            for size, number in states[at].phrases:
                if length >= size:
                    found.setdefault(number, []).append(place - size + 1)
            now = {number: (states[k].length, k) for number, k in states[at].shorter.items() if number >= first}
            now |= {number: (length, at) for number in states[at].ends if number >= first}
            note({number: run for number, run in held.items() if now.get(number, (0, 0))[0] != run[0] + 1}, place)
            held = now
        note(held, start + len(ids))

    @staticmethod
    def _chain(runs: list[tuple[int, int, list[int]]]) -> int:
        """The most words of a template that a chain of its runs covers: in order in both texts, overlaps counted once, at most MAX_GAP words of the document between two."""
        best: list[tuple[int, int, int]] = []
        most = low = 0
        for start, n, places in runs:
            stop = start + n
            # Runs come in the order of their ends; those that end too early are left behind.
            while low < len(best) and best[low][0] < start - MAX_GAP:
                low += 1
            fresh = []
            for place in places:
                covered = n
                for end, end_place, have in best[low:]:
                    over = max(0, end - start, end_place - (place - n))
                    if over < n and start + over - end <= MAX_GAP:
                        covered = max(covered, have + n - over)
                fresh.append((stop, place, covered))
                most = max(most, covered)
            best += fresh
        return most


@cache
def automaton(phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Automaton:
    return Automaton(phrases, templates)


_RESULT = StructType([
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()),
])


def license_of(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """struct(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text; a null text is empty. templates has (label, text)."""

    @F.arrow_udf(_RESULT)
    def scan(raws: pa.Array) -> pa.Array:
        machine = automaton(PHRASES, templates)
        rows = []
        for raw in raws:
            n, found, covers = machine.scan(raw.as_py())
            starts = [s for places in found.values() for s in places]
            base = {machine.phrases[k][1] for k in found}
            labels = base | {machine.templates[k - len(machine.phrases)][0] for k in covers}
            score = max([1.0 if base else 0.0, *covers.values()])
            rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _RESULT.names)

    return scan(text.cast("binary"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs.

    templates has (label, text): whole licence texts or notices, instead of the
    list of this module. They are held by the driver and each task, up to
    MAX_TEMPLATE_CHARS in all; rows with a null are left out. No phrase: n_base
    0, null first and last words, empty base_labels. score is 1 with a phrase,
    else the best cover of a template, else 0.
    """
    known = TEMPLATES
    if templates is not None:
        rows = templates.where("label is not null and text is not null").select(F.col("label").cast("string").alias("label"), F.col("text").alias("text")).distinct()
        if (rows.agg(F.sum(F.length("text"))).first()[0] or 0) > MAX_TEMPLATE_CHARS:
            raise ValueError(f"more than {MAX_TEMPLATE_CHARS} characters of templates")
        known = tuple(sorted((r["label"], r["text"]) for r in rows.collect()))
    return docs.select(F.col("doc_id").alias("doc_id"), license_of(F.col("text"), known).alias("s")).select("doc_id", "s.*")
