"""License scans with a positional rare-token index.

Templates are word sequences with a label, the least share of their words that
must match, and key phrases that must stand at their places.  The index maps
each template word to its postings (template, position).  Over all documents
the document frequency of every licence word is counted first.  A file then
looks up its licence words from the highest IDF down: a template is probed
through its rarest words, so many that one of them must be in any file with a
match (words that may miss, plus one); each occurrence minus the posting's
position gives the only start it can have.  Starts are scored by the share of
template words at their relative positions, then the mandatory key phrases are
verified.  Base phrases are templates of which every word must match, so their
places are found exactly.

Plan: one pass counts frequencies (partial sums, one row per licence word), one
pass scans; no text is shuffled, and the broadcast is the index, whose size the
template list fixes.

Null texts are empty; files without words have no matches and score 0; repeated
rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import text_slices, texts_of

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and bytes of other characters."""
    return text.translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    least: float = 1.0
    phrases: tuple[tuple[int, int], ...] = ()  # (start, end) in words
    base: bool = False


def template(label: str, text: str, least: float = 1.0, phrases: tuple[str, ...] = (), base: bool = False) -> Template:
    words, spans = tuple(words_of(text.encode())), []
    for p in phrases:
        own = tuple(words_of(p.encode()))
        spans.append(next((i, i + len(own)) for i in range(len(words)) if words[i:i + len(own)] == own))
    return Template(label, words, least, tuple(spans), base)


# The base phrases and their labels.
BASE = (
    template("mit", "mit license", base=True),
    template("apache", "apache license", base=True),
    template("gpl", "general public license", base=True),
)
# Opening sentences and notices of well-known licences.
NOTICES = (
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             0.8, ("permission is hereby granted",)),
    template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
             0.8, ("apache license", "not use this file except in compliance")),
    template("apache-2.0", "apache license version 2 0", 1.0),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
             0.8, ("free software", "general public license")),
    template("gpl-3", "gnu general public license version 3", 1.0),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             0.8, ("source and binary forms", "following conditions are met")),
    template("cc-by-nc", "licensed under cc by nc 4 0", 0.8, ("cc by nc",)),
    template("mpl", "this source code form is subject to the terms of the mozilla public license", 0.8, ("mozilla public license",)),
)
TEMPLATES = BASE + NOTICES


def frequencies(documents: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each licence word."""
    vocab = sorted({w for t in templates for w in t.words})

    def run(batches):
        of, n, held = {w: i for i, w in enumerate(vocab)}, 0, np.zeros(len(vocab), np.int64)
        own = frozenset(vocab)
        for b in text_slices(batches):
            n += b.num_rows
            for t in texts_of(b):
                for w in own.intersection(words_of(t)):
                    held[of[w]] += 1
        yield pa.record_batch([pa.array(range(-1, len(vocab)), pa.int32()), pa.array([n, *held.tolist()], pa.int64())], names=["at", "n"])
    rows = documents.select(F.col(text).alias("_text")).mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    got = {r.at: r.n for r in rows}
    return got.get(-1, 0), {w: got.get(i, 0) for i, w in enumerate(vocab)}


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, documents: int, held: dict[bytes, int], templates=TEMPLATES):
        self.templates = templates
        self.idf = {w: math.log((documents + 1) / (n + 1)) for w, n in held.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            may_miss = len(t.words) - math.ceil(t.least * len(t.words) - 1e-9)
            order = sorted(range(len(t.words)), key=lambda i: (-self.idf.get(t.words[i], 0.0), i))
            for i in order[:may_miss + 1]:
                self.postings.setdefault(t.words[i], []).append((k, i))
        self.rare = frozenset(self.postings)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, share of its words) of all verified places, in order."""
        held = self.rare.intersection(words)
        if not held:
            return []
        starts = set()
        for w in sorted(held, key=lambda w: (-self.idf[w], w)):
            at = -1
            for _ in range(words.count(w)):
                at = words.index(w, at + 1)
                starts.update((k, at - i) for k, i in self.postings[w])
        out = []
        for k, s in sorted(starts):
            t = self.templates[k]
            n = len(t.words)
            own = words[max(0, s):s + n]
            same = [a == b for a, b in zip(t.words[max(0, -s):], own)]
            share = sum(same) / n
            pad = max(0, -s)
            if share >= t.least and all(lo >= pad and all(same[lo - pad:hi - pad]) and hi - pad <= len(same) for lo, hi in t.phrases):
                out.append((k, max(0, s), share))
        return out


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, matches)``: ``matches`` holds (label, base, start
    word, share) of every verified place, by template, then start."""
    index = Index(*frequencies(documents, text, templates), templates)
    kind = documents.schema[key].dataType.simpleString()
    match = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        for b in text_slices(batches):
            words = [words_of(t) for t in texts_of(b)]
            got = [[{"label": templates[k].label, "base": templates[k].base, "start": s, "share": share} for k, s, share in index.matches(w)] for w in words]
            yield pa.record_batch([b.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(got, match)], names=["doc_id", "n_words", "matches"])
    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, matches array<struct<label:string,base:boolean,start:bigint,share:double>>")
