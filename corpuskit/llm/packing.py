"""Packing documents into token windows by lexical retrieval.

A document's ids are those of the tokenizer plus an end id.  What fills whole
windows of its own goes there; the rest, shorter than a window, is a unit that
is packed with others.  Units are indexed shard by shard in BM25 inverted lists
over token ids.  The first unused unit of a shard is the seed of a sequence: its
terms are the query, the unused units are its neighbours, best score first.
Those that fit whole are taken greedily; the best one left is cut to fill the
window to its last place, and its remainder stays in the index as an unused
unit.  The last sequence of a shard, which no unit is left to fill, is cut into
powers of two, so nothing is padded at all.

Plan: texts are tokenized where they are scanned, words that a worker has seen
before only once, and the ids are written once (two bytes each where the
vocabulary allows).  One pass over that copy counts every token's documents and
the mean length over all documents (at most a vocabulary of counts, so
broadcast).  The next pass packs: a shard is a run of at most ``shard_tokens``
ids in one task's split, so there is no shuffle, no key that could be hot and no
shard that grows.  Splits of written files don't move, so a task run again after
a lost executor gives the same sequences.

NULL and empty texts are documents of the end id alone.  Repeated rows and NULL
keys are packed each.  Texts are taken whole, however long: a document longer
than a window is a run of own sequences.  Ties go to the row that comes first.
An empty table gives an empty result.  Key columns keep names and types; those
that clash with result columns (in any case) raise.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import text_slices, written

KNOWN_WORDS, KNOWN_BYTES = 1 << 20, 32 << 20  # remembered by a worker; beyond, it starts anew
JOINED = 1024  # words per call of the tokenizer
K1, B = 1.2, 0.75
RESULT = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bm25")
_LETTERS = "a-zß-öø-ÿ"


class Words:
    """Token ids of texts; every distinct word goes to the tokenizer once while it is remembered."""

    def __init__(self, path: str, dtype):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.dtype = dtype
        # Where case and a space before a mark make no difference, fewer words are distinct.
        same = lambda *texts: len({tuple(e.ids) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)}) == 1
        letters = "".join(map(chr, range(97, 123)))
        self.folds = same(letters.upper(), letters) and all(same(f"a{m}{n}", f"a {m}{n}") for m in ".,;:!?" for n in (" b", "b", "."))
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.forget()

    def forget(self):
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _alone(self, words: list[str]):
        for lo in range(0, len(words), JOINED):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words[lo:lo + JOINED], add_special_tokens=False)]
            yield np.array([i for ids in got for i in ids], self.dtype), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, words: list[str]):
        """Ids of words of letters, many given as one text: an id that ends a word ends one of them."""
        for lo in range(0, len(words), JOINED):
            own = words[lo:lo + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, self.dtype)
            last = np.flatnonzero(self.ends_word[ids])
            if len(last) == len(own):
                yield ids, np.diff(last, prepend=-1)
            else:
                yield from self._alone(own)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many belong to each."""
        if len(self.known) > KNOWN_WORDS or self.known.nbytes > KNOWN_BYTES:
            self.forget()
        if self.folds:
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=f"([{_LETTERS}])([.,;:!?])", replacement=r"\1 \2")
        parts = pc.ascii_split_whitespace(texts)  # white space that the tokenizer drops and never reads across
        words = pc.list_flatten(parts).dictionary_encode()
        at = pc.index_in(words.dictionary, value_set=self.known)
        unknown = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        new = words.dictionary.take(pa.array(unknown))
        letters = pc.match_substring_regex(new, pattern=f"^[{_LETTERS}]+$")
        new = [new.filter(letters), new.filter(pc.invert(letters))]
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[unknown[np.argsort(~letters.to_numpy(zero_copy_only=False), kind="stable")]] = len(self.known) + np.arange(len(unknown))
        for own, read in zip(new, (self._joined, self._alone)):
            got = list(read(own.to_pylist()))
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in got)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *(lens for _, lens in got)]))])
        self.known = pa.concat_arrays([self.known, *new])
        at = at[words.indices.to_numpy()]
        lens = self.ends[at + 1] - self.ends[at]
        stop = np.cumsum(lens)
        out = self.ids[np.repeat(self.ends[at] - stop + lens, lens) + np.arange(stop[-1] if len(stop) else 0)]
        per_text = np.concatenate(([0], stop))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return out, np.diff(per_text)


def tokenized(documents: DataFrame, tokenizer: str, end_id: int, dtype, keep, text: str) -> DataFrame:
    """The columns ``keep``, the ids (``dtype``, little-endian) and their number."""
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("_ids", T.BinaryType()), T.StructField("_n", T.LongType())])

    def run(batches):
        # A Python worker that runs several tasks remembers the words of all of them.
        held = sys.modules.setdefault("corpuskit_packing_words", types.ModuleType("corpuskit_packing_words")).__dict__
        words = held.get((tokenizer, dtype.str)) or held.setdefault((tokenizer, dtype.str), Words(tokenizer, dtype))
        for b in batches:
            for part in text_slices([b], rows=1 << 13):
                m = part.num_columns - 1
                ids, lens = words.encode(pc.fill_null(part.column(m), ""))
                ends = np.cumsum(lens)
                ids = np.insert(ids, ends, end_id)
                size = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(size * ids.itemsize), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch([*part.columns[:m], data.cast(pa.binary()), pa.array(np.diff(size))], names=schema.names)
    return documents.select(*keep, F.col(text).cast("string").alias("_packing_text")).mapInArrow(run, schema)


def statistics(tokens: DataFrame, dtype) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length, and in how many of them each token id occurs."""
    def run(batches):
        df = np.zeros(1, np.int64)
        for b in batches:
            for ids in b.column(0):
                own = np.unique(np.frombuffer(ids.as_buffer(), dtype))
                if own[-1] >= len(df):
                    df = np.pad(df, (0, max(len(df), int(own[-1]) + 1 - len(df))))
                df[own] += 1
        used = np.flatnonzero(df)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(df[used], pa.int64())], names=["id", "n"])
    one = tokens.agg(F.count("*").alias("n"), F.avg("_n").alias("mean")).first()
    rows = tokens.select("_ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ids, ns = (np.array(c, np.int64) for c in zip(*rows.collect())) if one.n else (np.zeros(0, np.int64),) * 2
    df = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    df[ids] = ns
    return one.n, one.mean or 1.0, df


class Shard:
    """BM25 inverted lists over the units of one shard."""

    def __init__(self, units: list[np.ndarray], n: int, mean: float, df: np.ndarray):
        size = np.array([len(u) for u in units])
        code = np.concatenate(units).astype(np.int64) * len(units) + np.repeat(np.arange(len(units)), size)
        code, tf = np.unique(code, return_counts=True)
        term, self.unit = np.divmod(code, len(units))
        idf = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.unit] / mean))
        self.start = np.searchsorted(term, np.arange(len(df) + 1))
        by_unit = np.argsort(self.unit, kind="stable")
        self.terms, self.first = term[by_unit], np.searchsorted(self.unit[by_unit], np.arange(len(units) + 1))
        self.size = size

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every unit for the terms of ``seed``."""
        terms = self.terms[self.first[seed]:self.first[seed + 1]]
        lo, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.unit[at], self.weight[at], len(self.size))

    def sequences(self, window: int):
        """Lists of (unit, start in it, length, score; the seed's is None); all but the last fill the window."""
        rest, done = self.size.copy(), np.zeros(len(self.size), np.int64)
        for seed in range(len(rest)):
            while rest[seed]:  # more than once if it is cut to fill its own window's end
                scores = self.scores(seed)
                pieces = [(seed, int(done[seed]), int(rest[seed]), None)]
                room, rest[seed] = window - int(rest[seed]), 0
                ranked = np.flatnonzero(rest)
                ranked = ranked[np.argsort(-scores[ranked], kind="stable")]
                near = ranked
                while room and len(near := near[rest[near] <= room]):
                    j, near = near[0], near[1:]
                    pieces.append((int(j), int(done[j]), int(rest[j]), float(scores[j])))
                    room, rest[j] = room - int(rest[j]), 0
                ranked = ranked[rest[ranked] > 0]
                if room and len(ranked):
                    j = ranked[0]
                    pieces.append((int(j), int(done[j]), room, float(scores[j])))
                    done[j], rest[j] = done[j] + room, rest[j] - room
                yield pieces


def powers_of_two(pieces, length: int, window: int):
    """``pieces`` of ``length`` ids in sequences without padding: whole if they fill the window, else by powers of two."""
    if length == window:
        return [pieces]
    out, room = [], 0
    for unit, start, n, score in pieces:
        while n:
            if not room:
                room = 1 << (length.bit_length() - 1)
                length -= room
                out.append([])
            got = min(n, room)
            out[-1].append((unit, start, got, score))
            start, n, room = start + got, n - got, room - got
    return out


def pack(documents: DataFrame, tokenizer: str, end_id: int, keep=("doc_id",), text: str = "text", window: int = 4096,
         vocabulary: int = 1 << 16, shard_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: the columns ``keep``, ``start`` and ``length`` in its
    document, ``ids`` (unsigned 32-bit little-endian), ``doc_tokens`` (end id
    included), ``sequence_id``, ``offset`` there, and ``bm25`` towards the
    sequence's seed (NULL for the seed itself).

    ``tokenizer``: a file of the tokenizers library whose ids are below
    ``vocabulary``; it has to exist on every machine and drop white space.
    ``window``: a power of two."""
    keep = list(keep)
    clash = {c.lower() for c in keep} & {*RESULT, "_ids", "_n"}
    if clash:
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    dtype = np.dtype("<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4")
    tokens = written(tokenized(documents, tokenizer, end_id, dtype, keep, text), "tokens")
    shared = documents.sparkSession.sparkContext.broadcast(statistics(tokens, dtype))
    fields = [T.StructField(c, t) for c, t in zip(RESULT, (T.LongType(), T.LongType(), T.BinaryType(), *[T.LongType()] * 3, T.DoubleType()))]
    schema = T.StructType([*tokens.select(*keep).schema.fields, *fields])
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def run(batches):
        n, mean, df = shared.value
        sequence = TaskContext.get().partitionId() << 40

        def packed(rows):
            """``rows``: (batch of one row, ids)."""
            nonlocal sequence
            units = [(i, len(ids) // window * window) for i, (_, ids) in enumerate(rows) if len(ids) % window]
            own = ([(i, at, window, None)] for i, (_, ids) in enumerate(rows) for at in range(0, len(ids) - window + 1, window))
            shard = Shard([rows[i][1][lo:] for i, lo in units], n, mean, df).sequences(window) if units else ()
            out, at = [], []
            for real in (own, ([(units[u][0], units[u][1] + s, m, score) for u, s, m, score in p] for p in shard)):
                for pieces in real:
                    for parts in powers_of_two(pieces, sum(p[2] for p in pieces), window):
                        offset = 0
                        for i, start, length, score in parts:
                            ids = rows[i][1]
                            out.append((start, length, ids[start:start + length].astype("<u4").tobytes(), len(ids), sequence, offset, score))
                            at.append(i)
                            offset += length
                        sequence += 1
            keys = pa.Table.from_batches([r for r, _ in rows]).take(pa.array(at)).combine_chunks()
            for lo in range(0, len(out), 1024):
                part = list(zip(*out[lo:lo + 1024]))
                yield pa.record_batch([*(c.chunk(0) for c in keys.slice(lo, 1024).columns), *map(pa.array, part, kinds)], names=schema.names)

        rows, held = [], 0
        for b in batches:
            m = b.num_columns - 1
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(m)[i].as_buffer(), dtype)
                if rows and held + len(ids) > shard_tokens:
                    yield from packed(rows)
                    rows, held = [], 0
                rows.append((b.slice(i, 1).select(range(m)), ids))
                held += len(ids)
        if rows:
            yield from packed(rows)
    return tokens.select(*keep, "_ids").mapInArrow(run, schema)
