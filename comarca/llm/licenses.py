"""License scans: template markup compiled into token automata.

A template is wording with ``[[...]]`` around optional regions, which may nest, and ``{{a-b}}`` for a replaceable
region of a to b words. Everything else is mandatory and must match word for word. An automaton is
run only from the places where one of the words that can open its template stands.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from comarca.llm.frames import with_text
from comarca.llm.words import LETTERS, Words, lower, slices, word_hash

#: Phrases whose places are counted, and the label each gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> templates, lower case, words only. Public license and notice wording.
TEMPLATES = {
    "mit-notice": ["[[this {{0-3}} is]] released under the [[terms of the]] mit license"],
    "apache-2.0": ["licensed under the apache license [[version 2 0]] [[the license]]"],
    "gpl-3.0": [
        "licensed under the [[terms of the]] gnu general public license version 3",
        "terms of the gnu general public license as published by the free software foundation either version 3",
    ],
    "gpl-2.0": [
        "licensed under the [[terms of the]] gnu general public license version 2",
        "terms of the gnu general public license as published by the free software foundation either version 2",
    ],
    "cc-by-nc-4.0": [
        "licensed under [[a]] cc by nc 4 0",
        "creative commons attribution noncommercial 4 0 international [[public]] license",
    ],
    "reserved": ["[[copyright {{0-12}}]] all rights reserved"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software [[and to permit persons to whom the software is furnished to do so]] subject to the "
        "following conditions"
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met [[1]] redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary "
        "form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution"
    ],
    "bsd-3-clause": [
        "disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the "
        "name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission"
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be "
        "held liable for any damages arising from the use of this software"
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def parse(template: str):
    """Nested items: a word, ``("any", a, b)`` or ``("optional", items)``."""
    stack = [[]]
    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            items = stack.pop()
            stack[-1].append(("optional", items))
        elif part.startswith("{{"):
            low, high = part[2:-2].split("-")
            stack[-1].append(("any", int(low), int(high)))
        else:
            stack[-1].append(part)
    if len(stack) != 1:
        raise ValueError(f"unbalanced template: {template}")
    return stack[0]


class Automaton:
    """Word automaton of one template. State 0 starts, ``accept`` accepts; edges carry a hash or any word (None)."""

    def __init__(self, template: str):
        self.edges, self.free = [], []
        self.accept = self._add(parse(template), self._state())
        start = self._close({0})
        if self.accept in start or any(h is None for s in start for h, _ in self.edges[s]):
            raise ValueError(f"a template must open with mandatory or optional wording: {template}")
        self.openers = {h for s in start for h, _ in self.edges[s]}

    def _state(self):
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _add(self, items, at):
        for item in items:
            if isinstance(item, str):
                after = self._state()
                self.edges[at].append((word_hash(item), after))
            elif item[0] == "optional":
                last = self._add(item[1], at)
                after = self._state()
                self.free[last].append(after)
                self.free[at].append(after)
            else:
                after = self._state()
                for k in range(item[2] + 1):
                    if k >= item[1]:
                        self.free[at].append(after)
                    if k < item[2]:
                        step = self._state()
                        self.edges[at].append((None, step))
                        at = step
            at = after
        return at

    def _close(self, states):
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts_at(self, hashes, at, end) -> bool:
        """Whether some run of words from ``at`` on spells the template."""
        states = self._close({0})
        while states and at < end:
            h = int(hashes[at])
            states = self._close({s for t in states for g, s in self.edges[t] if g is None or g == h})
            if self.accept in states:
                return True
            at += 1
        return False


def scan_licenses(documents: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``documents(doc_id, text)``, see ``SCHEMA``; null texts count as empty.

    ``labels`` are those of phrases and of templates accepted anywhere in the text. ``score`` is 1 with an
    accepted template, 0.5 with a phrase alone, else 0. Texts without a word give zeros, nulls and empty labels.
    """

    def scan(batches):
        spelled = [(label, [word_hash(w) for w in p.split()]) for p, label in phrases.items()]
        machines = [(label, Automaton(t)) for label, texts in templates.items() for t in texts]
        # an automaton is tried only where the text holds all of its mandatory words' first opener
        openers = np.array(sorted({h for _, m in machines for h in m.openers}), np.uint64)
        needed = [np.array(sorted(_mandatory(m)), np.uint64) for _, m in machines]
        watched = np.array(sorted(set(openers.tolist()).union(*(n.tolist() for n in needed))), np.uint64)
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in slices(batch.column("text")):
                words = Words(lower(data), offsets, LETTERS)
                hashes, out = words.hashes(), []
                places, owner = [], []
                for label, phrase in spelled:
                    n = len(hashes) - len(phrase) + 1
                    at = np.flatnonzero(hashes[: max(n, 0)] == phrase[0])
                    for k, h in enumerate(phrase[1:], 1):
                        at = at[hashes[at + k] == h]
                    text = np.searchsorted(words.first, at, "right") - 1
                    at = at[at + len(phrase) <= words.first[text + 1]]
                    places.append(at)
                    owner.append((label, np.searchsorted(at, words.first)))
                where = np.searchsorted(watched, hashes)
                known = watched[np.minimum(where, len(watched) - 1)] == hashes
                spots = np.flatnonzero(known)
                bounds = np.searchsorted(spots, words.first)
                for i, n in enumerate(words.counts):
                    begin, end = words.first[i], words.first[i + 1]
                    base = {label: at[b[i] : b[i + 1]] for at, (label, b) in zip(places, owner) if b[i] < b[i + 1]}
                    mine = spots[bounds[i] : bounds[i + 1]]
                    labels = set(base)
                    if len(mine):
                        held = np.unique(hashes[mine])
                        for (label, machine), must in zip(machines, needed):
                            if label not in labels and np.isin(must, held).all():
                                starts = mine[np.isin(hashes[mine], list(machine.openers))]
                                if any(machine.accepts_at(hashes, s, end) for s in starts):
                                    labels.add(label)
                    found = np.concatenate(list(base.values())) - begin if base else []
                    score = 1.0 if labels - set(base) else 0.5 if base else 0.0
                    out.append((
                        int(n), len(found), *((int(min(found)), int(max(found))) if base else (None, None)),
                        ",".join(sorted(base)), ",".join(sorted(labels)), score,
                    ))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)]
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(out)), *columns], _NAMES)

    return with_text(documents, "doc_id", "text").mapInArrow(scan, SCHEMA)


_TYPES = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]


def _mandatory(machine: Automaton) -> set:
    """Words on every way through the automaton: without one of them nothing is accepted."""
    names = {h for edges in machine.edges for h, _ in edges if h is not None}

    def passable(without):
        todo, seen = [0], {0}
        while todo:
            s = todo.pop()
            for t in [*machine.free[s], *(t for h, t in machine.edges[s] if h != without)]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return machine.accept in seen

    return {h for h in names if not passable(h)}


def to_regex(template: str) -> str:
    """The template over words joined as ``' a b c '``."""

    def spell(items):
        out = ""
        for item in items:
            if isinstance(item, str):
                out += item + " "
            elif item[0] == "optional":
                out += f"({spell(item[1])})?"
            else:
                out += f"([^ ]+ ){{{item[1]},{item[2]}}}"
        return out

    return " " + spell(parse(template))


def oracle(phrases=PHRASES, templates=TEMPLATES) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    starts, has, found = [], [], []
    for phrase, label in phrases.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(1, len(w) + 1), lambda i: {same})")
        has.append(f"CASE WHEN contains(j, ' {phrase} ') THEN '{label}' END")
    for label, texts in templates.items():
        any_of = " OR ".join(f"regexp_matches(j, '{to_regex(t)}')" for t in texts)
        found.append(f"CASE WHEN {any_of} THEN '{label}' END")
    joined = "list_filter([{}], lambda x: x IS NOT NULL)".format
    return rf"""
        WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
        b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' j FROM a),
        c AS (SELECT doc_id, len(w) n_words, flatten([{", ".join(starts)}]) p, {joined(", ".join(has))} bl,
            {joined(", ".join(found))} tl FROM b)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
            list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
            array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(bl || tl)), ',') AS labels,
            CAST(CASE WHEN len(list_filter(tl, lambda x: NOT list_contains(bl, x))) > 0 THEN 1 WHEN len(bl) > 0 THEN 0.5 ELSE 0 END
                AS DOUBLE) AS score
        FROM c"""
