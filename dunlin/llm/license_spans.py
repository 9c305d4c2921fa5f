"""License scans with a generalised suffix automaton of template tokens.

The templates are short license texts and the phrases that name a license.  Their tokens make one automaton of all
their substrings.  A file is streamed through it: at each word it tells the longest match that ends there, and the
places of that match in the templates.  Matches that cannot be lengthened are chained in order, template by template,
and a chain that covers enough of its template is a span with the template's label.  A phrase stands wherever the
state of the match has the state of the phrase among its suffixes.

Only stretches whose neighbouring words are neighbours in some template enter the automaton; no match of two words or
more is lost by that.  Words are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z as a-z.

Defined results: null and empty text have no words, no places, no spans and score 0; a word of any length is one
word; overlapping places all count; equal spans of templates with one label are listed once each; repeated rows are
answered alike; other columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm.common import pieces, read, text_buffer, word_hashes, words

#: Phrases that name a license (base labels).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: License templates: a label and public wording of the license or of a reference to it.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
            "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
                "free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
                "free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
             "the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]
#: Words of the shortest match that is chained, words that may lie between two matches, and the share of a template that a span needs.
LEAST, GAP, COVER = 3, 8, 0.8
#: Bytes of one text whose words are found at a time.
PART = 4 << 20
_LOWER = "abcdefghijklmnopqrstuvwxyz"
APART = np.zeros(256, bool)
APART[:0x80] = True
APART[[ord(c) for c in "0123456789" + _LOWER + _LOWER.upper()]] = False


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)     # (template, place of the last token)


class Automaton:
    """All substrings of the templates' tokens, with their places."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> None:
        self.phrases = [(label, text.split()) for text, label in (PHRASES if phrases is None else phrases)]
        self.templates = [(label, text.split()) for label, text in (TEMPLATES if templates is None else templates)] + self.phrases
        vocabulary = sorted({w for _, t in self.templates for w in t})
        self.words = [w.encode() for w in vocabulary]
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.states = [State(0)]
        self.rows: list[list[int]] = []
        pairs = set()
        for number, (_, tokens) in enumerate(self.templates):
            row, last = [self.ids[w] for w in tokens], 0
            for place, token in enumerate(row):
                last = self._extend(last, token)
                self.states[last].ends.add((number, place))
            self.rows.append(row)
            pairs.update(zip(row, row[1:]))
        for v in sorted(range(1, len(self.states)), key=lambda v: -self.states[v].length):
            self.states[self.states[v].link].ends |= self.states[v].ends
        self.states[0].ends = set()
        marks: dict[int, list[tuple[int, str]]] = {}
        for label, tokens in self.phrases:
            v = 0
            for w in tokens:
                v = self.states[v].next[self.ids[w]]
            marks.setdefault(v, []).append((len(tokens), label))
        self.marks: list[list[tuple[int, str]]] = [[] for _ in self.states]     # phrases that end with the matches of a state
        for v in sorted(range(1, len(self.states)), key=lambda v: self.states[v].length):
            self.marks[v] = self.marks[self.states[v].link] + marks.get(v, [])
        #: Places of a state's matches, and of their shorter ends in other templates: (template, place, greatest length).
        self.reach: list[list[tuple[int, int, int]]] = [[]]
        for v in range(1, len(self.states)):
            found: dict[tuple[int, int], int] = {}
            u, most = v, self.states[v].length
            while u > 0:
                for at in self.states[u].ends:
                    found.setdefault(at, most)
                u = self.states[u].link
                most = self.states[u].length
            self.reach.append([(number, end, most) for (number, end), most in sorted(found.items()) if most >= min(LEAST, len(self.rows[number]))])
        self.hashes, self.order = self._vocabulary_hashes()
        self.pairs = np.sort(np.array([a * len(self.words) + b for a, b in pairs], np.int64))

    def _extend(self, last: int, token: int) -> int:
        s = self.states
        if token in s[last].next:
            q = s[last].next[token]
            return q if s[q].length == s[last].length + 1 else self._clone(last, q, token)
        new = len(s)
        s.append(State(s[last].length + 1))
        p = last
        while p != -1 and token not in s[p].next:
            s[p].next[token] = new
            p = s[p].link
        if p == -1:
            s[new].link = 0
        else:
            q = s[p].next[token]
            s[new].link = q if s[q].length == s[p].length + 1 else self._clone(p, q, token)
        return new

    def _clone(self, p: int, q: int, token: int) -> int:
        s = self.states
        copy = len(s)
        s.append(State(s[p].length + 1, s[q].link, dict(s[q].next)))
        while p != -1 and s[p].next.get(token) == q:
            s[p].next[token] = copy
            p = s[p].link
        s[q].link = copy
        return copy

    def _vocabulary_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(self.words), np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]), APART)
        hashes = word_hashes(data, starts, ends)
        order = np.argsort(hashes)
        return hashes[order], order

    # ------------------------------------------------------------ streaming

    def token_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary number of every word (-1: none) and the first word of each row."""
        if len(data) > 2 * PART and len(off) == 2:           # a very long text in parts cut between words
            found, at = [], 0
            while at < len(data):
                end = min(at + PART, len(data))
                while end < len(data) and not APART[data[end]]:
                    more = np.flatnonzero(APART[data[end:end + PART]])
                    end = end + int(more[0]) if len(more) else min(end + PART, len(data))
                found.append(self._ids(data[at:end], np.array([0, end - at]))[0])
                at = end
            ids = np.concatenate(found)
            return ids, np.array([0, len(ids)])
        return self._ids(data, off)

    def _ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = words(data, off, APART)
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == hashes, self.order[at], -1).astype(np.int32)
        good = self._neighbours(ids)
        near = np.zeros(len(ids), bool)                       # only words that may enter the automaton are looked at again
        near[:1] = near[-1:] = True
        near[:-1] |= good
        near[1:] |= good
        for k in np.flatnonzero(near & (ids >= 0)).tolist():
            if data[starts[k]:ends[k]].tobytes().lower() != self.words[ids[k]]:
                ids[k] = -1                                   # another word with the same hash
        return ids, first

    def _neighbours(self, ids: np.ndarray) -> np.ndarray:
        """For each word but the last: whether it and the next stand side by side in some template."""
        good = np.zeros(max(len(ids) - 1, 0), bool)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[both].astype(np.int64) * len(self.words) + ids[both + 1]
        good[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
        return good

    def stretches(self, ids: np.ndarray, first: np.ndarray):
        """(row, place in the row, ids) of the stretches whose neighbours are neighbours in a template."""
        if len(ids) < 2:
            return
        good = self._neighbours(ids)
        inner = first[1:-1]
        good[inner[(inner > 0) & (inner < len(ids))] - 1] = False
        padded = np.concatenate([[False], good, [False]])
        lo, hi = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(~padded[1:] & padded[:-1]) + 1
        row = np.searchsorted(first, lo, side="right") - 1
        for r, x, y in zip(row.tolist(), lo.tolist(), hi.tolist()):
            yield r, x - int(first[r]), ids[x:y].tolist()

    def matches(self, tokens: list[int]):
        """(end, length, state) of the longest match that ends at each token."""
        s, v, length = self.states, 0, 0
        for i, token in enumerate(tokens):
            while v and token not in s[v].next:
                v = s[v].link
                length = s[v].length
            v = s[v].next.get(token, 0)
            length = length + 1 if v else 0
            yield i, length, v

    def scan(self, stretches: list[tuple[int, list[int]]]):
        """Phrases (start, label) and segments (template, start, end, first token, token after the last) of one text."""
        places, segments = [], []
        for base, tokens in stretches:
            for i, length, v in self.matches(tokens):
                for size, label in self.marks[v]:
                    if size <= length:
                        places.append((base + i - size + 1, label))
                following = tokens[i + 1] if i + 1 < len(tokens) else -1
                for number, end, most in self.reach[v]:
                    row, n = self.rows[number], min(most, length)
                    if n >= min(LEAST, len(row)) and (end + 1 == len(row) or row[end + 1] != following):     # it cannot be lengthened there
                        segments.append((number, base + i - n + 1, base + i + 1, end - n + 1, end + 1))
        return places, segments

    def chains(self, segments: list[tuple[int, int, int, int, int]]):
        """(template, start, end, covered share): the best chain that ends with each segment, none inside another."""
        out = []
        by_template: dict[int, list] = {}
        for number, *rest in segments:
            by_template.setdefault(number, []).append(tuple(rest))
        for number, row in by_template.items():
            size = len(self.templates[number][1])
            row = sorted(set(row))
            best: list[tuple[int, int]] = []        # tokens covered, start of the chain
            low = 0
            for j, (start, end, t0, t1) in enumerate(row):
                while low < j and row[low][0] < start - GAP - size:
                    low += 1
                value = (t1 - t0, -start)
                for i in range(low, j):
                    p_start, p_end, q0, q1 = row[i]
                    over = max(p_end - start, q1 - t0, 0)           # what both hold counts once
                    if p_end < end and q1 < t1 and p_start < start and q0 < t0 and start - p_end <= GAP and t0 - q1 <= GAP and over < t1 - t0:
                        value = max(value, (best[i][0] + t1 - t0 - over, best[i][1]))
                best.append(value)
            spans = sorted(((-tokens, -begin, row[j][1]) for j, (tokens, begin) in enumerate(best)))
            taken: list[tuple[int, int]] = []       # disjoint, in order
            for tokens, start, end in spans:
                if -tokens >= COVER * size or not taken:
                    at = bisect.bisect_left(taken, (start, end))
                    if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                        taken.insert(at, (start, end))
                        out.append((number, start, end, min(1.0, -tokens / size)))
        return sorted(out)


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, places (label, start) of the phrases, spans (label, start, end, share) of the templates, score.

    The score is the largest share of any template, phrases included, that stands in the text.  Nothing is shuffled;
    the automaton has the size of the templates."""
    tool = docs.sparkSession.sparkContext.broadcast(Automaton(templates, phrases))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        a = tool.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, first = a.token_ids(*text_buffer(piece.column("text")))
                rows: dict[int, list] = {}
                for r, at, tokens in a.stretches(ids, first):
                    rows.setdefault(r, []).append((at, tokens))
                n = piece.num_rows
                places, spans, score = [[] for _ in range(n)], [[] for _ in range(n)], [0.0] * n
                for r, stretches in rows.items():
                    found, segments = a.scan(stretches)
                    chains = a.chains(segments)
                    places[r] = [{"label": label, "start": start} for start, label in sorted(found)]
                    spans[r] = [{"label": a.templates[t][0], "start": x, "end": y, "share": share} for t, x, y, share in chains
                                if share >= COVER and t < len(a.templates) - len(a.phrases)]
                    score[r] = max([share for _, _, _, share in chains], default=0.0)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(places, pa.list_(_PLACE)),
                                                  pa.array(spans, pa.list_(_SPAN)), pa.array(score, pa.float64())], ["doc_id", "n_words", "places", "spans", "score"])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        apply, f"doc_id {kind}, n_words long, places array<struct<label string, start long>>, spans array<struct<label string, start long, end long, share double>>, score double")


def op13_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and spans of license templates in every document."""
    x = license_spans(read(spark, sf_dir, "documents"))
    base = F.array_distinct(F.col("places.label"))
    return x.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
                    F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("spans.label"))), ",").alias("labels"), "score")
