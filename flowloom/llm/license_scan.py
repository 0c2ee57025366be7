"""Licence scan: a generalised suffix automaton of licence tokens gives matching statistics, and long matches are chained.

Each document is streamed through the automaton word by word. The state says which licence strings end at the word, so the
phrases of the base rule are found at every place; maximal matches are chained per template into covered spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.common import map_rows, table

#: Phrases of the base rule and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Publicly known licence notices, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Bytes that end a word: 00-2F, 3A-60 and 7B-7F, after A-Z are lower case.
_SPACED = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
#: A text is cut into words in pieces of about so many bytes.
PIECE = 1 << 20


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, some at a time, so that a long text does not become one long list."""
    at, end = 0, len(text)
    while at < end:
        cut = min(end, at + PIECE)
        piece = text[at:cut].lower().translate(_SPACED)
        if cut < end:
            last = piece.rfind(b" ")
            if last < 0:  # one word over the whole piece: take up to where it ends
                m = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, cut)
                cut = m.start() if m else end
                piece = text[at:cut].lower().translate(_SPACED)
            else:
                cut, piece = at + last + 1, piece[: last + 1]
        at = cut
        yield piece.split()


def words_of(text: bytes) -> list[bytes]:
    return [w for piece in word_pieces(text) for w in piece]


@dataclass
class SuffixAutomaton:
    """Of several token strings. length, link and next describe the states; ends: (string, last index) of a state's strings."""

    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:  # another string has it already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def add(self, string: int, tokens: list[int]) -> None:
        last, states = 0, []
        for token in tokens:
            last = self._extend(last, token)
        at = 0  # states may have been split since: walk the string again
        for i, token in enumerate(tokens):
            at = self.next[at][token]
            states.append((at, i))
        self._marks = getattr(self, "_marks", []) + [(string, tokens)]

    def finish(self) -> SuffixAutomaton:
        """Hand every end on along the suffix links, longest states first."""
        for string, tokens in self._marks:
            at = 0
            for i, token in enumerate(tokens):
                at = self.next[at][token]
                self.ends[at].add((string, i))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]
        return self

    def find(self, tokens: list[int]) -> int:
        at = 0
        for token in tokens:
            at = self.next[at][token]
        return at


class LicenseIndex:
    """min_match: words from which a match is long. gap: most words left out between chained matches, in text and template.
    cover: share of a template's words from which its chain counts."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, min_match: int = 4, gap: int = 12, cover: float = 0.8):
        self.min_match, self.gap, self.cover = min_match, gap, cover
        texts = [(label, words_of(text.encode())) for label, text in templates]
        self.n_templates, self.labels = len(texts), [label for label, _ in texts] + list(phrases.values())
        texts += [(label, words_of(phrase.encode())) for phrase, label in phrases.items()]
        self.sizes = [len(words) for _, words in texts]
        self.tokens: dict[bytes, int] = {}
        strings = [[self.tokens.setdefault(w, len(self.tokens)) for w in words] for _, words in texts]
        self.sam = sam = SuffixAutomaton()
        for i, string in enumerate(strings):
            sam.add(i, string)
        sam.finish()
        #: For each state, the phrases that end there: (words, number), of the state itself or of one up its links.
        own: dict[int, list[tuple[int, int]]] = {}
        for i in range(self.n_templates, len(strings)):
            own.setdefault(sam.find(strings[i]), []).append((len(strings[i]), i))
        self.phrases: list[tuple[tuple[int, int], ...]] = []
        for s in range(len(sam.length)):
            got, at = [], s
            while at > 0:
                got += own.get(at, [])
                at = sam.link[at]
            self.phrases.append(tuple(got))

    def scan(self, text: bytes) -> dict:
        """n_words, the base places (first word, phrase), and the template spans (template, first word, end, words covered)."""
        sam_next, link, length, phrases, token, least = self.sam.next, self.sam.link, self.sam.length, self.phrases, self.tokens.get, self.min_match
        n, state, size = 0, 0, 0
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # end word, words, state: those that the next word does not extend
        for piece in word_pieces(text):
            for i, t in enumerate(map(token, piece), n):
                if t is None:
                    if size:
                        if size >= least:
                            matches.append((i, size, state))
                        state = size = 0
                    continue
                if (to := sam_next[state].get(t)) is not None:
                    state, size = to, size + 1
                else:
                    if size >= least:
                        matches.append((i, size, state))
                    while state and (to := sam_next[state].get(t)) is None:
                        state = link[state]
                    if to is None:
                        to = sam_next[0].get(t)
                    size = length[state] + 1
                    state = to
                if phrases[state]:
                    places += [(i - k + 1, p) for k, p in phrases[state] if k <= size]
            n += len(piece)
        if size >= least:
            matches.append((n, size, state))
        return {"n_words": n, "places": places, "spans": self.chain(matches)}

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Matches in text order join a template's open chain if both go on within the gap; chains that cover enough count."""
        open_: dict[int, list[int]] = {}  # template: first word, end word, end in template, covered
        done = []

        def close(t: int) -> None:
            first, end, _, covered = open_.pop(t)
            if covered >= self.cover * self.sizes[t]:
                done.append((t, first, end, covered))

        for end, size, state in matches:
            for t, last in sorted(self.sam.ends[state]):
                if t >= self.n_templates or last + 1 < size:
                    continue
                if c := open_.get(t):
                    new = min(size, end - c[1], last + 1 - c[2])  # words that the chain has not yet
                    if new > 0 and end - new - c[1] <= self.gap and last + 1 - new - c[2] <= self.gap:
                        c[1:] = [end, last + 1, c[3] + new]
                        continue
                    if c[3] >= size and c[3] < self.cover * self.sizes[t] and end - c[1] <= self.gap:
                        continue  # another place of the same template, and the open chain has more
                    close(t)
                open_[t] = [end - size, end, last + 1, size]
        for t in list(open_):
            close(t)
        return sorted(done, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first_word, end_word).

    docs has doc_id and text; other columns are left out, repeated rows stay, and an empty table gives none. Null or empty text:
    no words, score 0. score: share of words within base places or spans. Labels of copies in a text count once.
    """
    index = index or LicenseIndex()

    def rows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in cols["text"]:
            x = index.scan(text or b"")
            places, spans = x["places"], x["spans"]
            base = {index.labels[p] for _, p in places}
            starts = [i for i, _ in places]
            covered, upto = 0, 0
            for first, end in sorted([(i, i + index.sizes[p]) for i, p in places] + [(s[1], s[2]) for s in spans]):
                covered += max(0, end - max(first, upto))
                upto = max(upto, end)
            row = (x["n_words"], len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {index.labels[s[0]] for s in spans})), covered / x["n_words"] if x["n_words"] else 0.0, [{"label": index.labels[t], "first_word": first, "end_word": end} for t, first, end, _ in spans])
            for k, v in zip(out, row):
                out[k].append(v)
        return {"doc_id": cols["doc_id"]} | out

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, end_word: long>>"
    return map_rows(docs.select("doc_id", "text"), rows, schema, binary=("text",))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
