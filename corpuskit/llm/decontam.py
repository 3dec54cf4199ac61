"""Benchmark decontamination: CGK walks, bit-sampling LSH, exact edit check.

Texts and items are normalised to lower-case words with one space between.  An
item leaks if some substring of the text is within ``1 - similarity`` edits per
character of the item's normalised text.

1. A CGK walk reads a string along random bits: at step j it writes the
   character under the pointer and moves on if the j-th bit of that character is
   set.  Two walks over strings that differ by an edit fall into step again, so
   few edits become few differing places of the walks' outputs (Hamming
   distance).
2. Bit-sampling: a table samples one place out of every two of a walk; its key
   hashes the samples.  Tables have walks and samples of their own.
3. The window of an item's size that leaks starts anywhere.  The index holds the
   keys of walks from *every* place of every item; the text is probed every
   ``STRIDE`` bytes.  A hit names an item and a diagonal (place in the text less
   place in the item), that is, an item-sized window.  Windows whose hits lie in
   enough different regions are candidates.  There are as many tables as make
   four hits likely, at the edit budget, in a window of ``TYPICAL`` bytes.
4. Candidates are verified exactly by Myers' bit-parallel edit distance over the
   whole item, many candidates side by side.

The cost follows probes times tables, not items.  The search can lose leaks near
the edit budget; what it reports is exact.  Recall against brute force, random
letter noise of 20 %, the whole budget: see tests (0.9 and more; below 15 % noise
nearly 1).  Items of under ``SHORT`` characters are cut into one piece more than
edits are allowed, so one piece is whole: their search loses nothing.  Items of
under ``MIDDLE`` are probed every second byte by shorter walks.

Everything about a text happens in its own task: no shuffle, no join, no row
is collected.  Items come in passes whose indexes stay within ``index_bytes``;
each is broadcast as plain arrays, and results of a pass are written before the
next one, so no two are held at once.

NULL and empty texts leak nothing; items without words (NULL texts too) take no
part.  Scripts without spaces go the same way as all others.  Texts are searched
whole, block by block, however long.  Equal items are all reported; repeated rows
give repeated results; the place is that of the nearest, then first, substring;
an empty table gives an empty result.  Columns of ``documents`` keep names and
types; ``leaks`` reads two of them only, so others can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuskit.llm.common import released, text_slices, written

SEPARATORS = r"[^\p{L}\p{N}]+"
SHORT, MIDDLE, SURE, TYPICAL = 32, 64, 100, 128  # characters of an item: lossless pieces, denser probes, one hit is enough; bytes
STEPS, STRIDE, REGION = 24, 6, 16
BITMAP = 22
BLOCK, PROBES = 1 << 23, 1 << 17  # bytes searched together, and walked together
SHIFT, RUN = 5, 4  # diagonals in a bin, as a power of two, at least; bins verified together at most
ABREAST, CLASSES = 4096, 64  # candidates verified at once, kinds of characters they tell apart
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-case words (letters and digits) with one space between; NULL stays."""
    return pc.ascii_trim(pc.replace_substring_regex(pc.utf8_lower(texts), pattern=SEPARATORS, replacement=" "), characters=" ")


def words_of(text: str | None) -> list[str]:
    return (normalised(pa.array([text], pa.string()))[0].as_py() or "").split()


def substring_distance(item: str, text: str) -> int:
    """Least edit distance between ``item`` and any substring of ``text``."""
    if item in text:
        return 0
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), np.uint32).tolist(), 1):
        new = np.minimum(row + 1, np.concatenate(([i], row[:-1] + (t != c))))
        row = np.minimum.accumulate(new - at) + at  # insertions
    return int(row.min())


def masks(item: str) -> dict[str, int]:
    """Places of each character as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(item: str, text: str, anchored: bool = False):
    """Least edit distance of ``item`` and a substring of ``text`` that ends (``anchored``:
    and the prefix that ends) at each place (Myers 1999, Hyyro 2003)."""
    places, far, first = masks(item), len(item), int(anchored)
    every, top = (1 << far) - 1, 1 << (far - 1)
    up, down = every, 0
    for c in text:
        eq = places.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq
        h_up, h_down = down | (every & ~(x | up)), up & x
        far += (h_up & top > 0) - (h_down & top > 0)
        h_up, x = h_up << 1 | first, eq | down
        up, down = (h_down << 1 | ~(x | h_up)) & every, h_up & x & every
        yield far


@dataclass(frozen=True)
class Walk:
    """One table's walk: ``moves[j, byte]`` tells whether step j moves on, ``taken`` which steps are sampled."""
    moves: np.ndarray
    taken: np.ndarray

    @staticmethod
    def random(rng: np.random.Generator, steps: int) -> Walk:
        pick = np.arange(0, steps, 2) + rng.integers(0, 2, steps // 2)
        return Walk((rng.random((steps, 256)) < 0.5).astype(np.intp), np.isin(np.arange(steps), pick))

    @staticmethod
    def plain(size: int) -> Walk:
        """Reads ``size`` bytes as they are."""
        return Walk(np.ones((size, 256), np.intp), np.ones(size, bool))

    def keys(self, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of the walk from each ``start``, and where it ends; ``text`` must go on for as many bytes as steps."""
        at, h = start.copy(), np.zeros(len(start), np.uint64)
        for moves, taken in zip(self.moves, self.taken.tolist()):
            c = text[at]
            if taken:
                h += c
                h += np.uint64(1)
                h *= _PRIME
            at += moves[c]
        return h ^ (h >> np.uint64(29)), at


def tables_for(similarity: float) -> int:
    """Tables that make four hits in ``TYPICAL`` bytes likely when the edit budget is used up: a
    walk of STEPS reads about half as many characters, and hits at least if none is edited."""
    return max(1, int(np.ceil(4 / (TYPICAL / STRIDE * max(similarity, 0.05) ** (STEPS / 2)) - 1e-9)))


class Index:
    """The LSH tables of the items of one pass, ``items``: (item id, text)."""

    def __init__(self, items, similarity: float, seed: int = 9):
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be over 0")
        items = list(items)
        norm = normalised(pa.array([t for _, t in items], pa.string())).to_pylist()
        self.items = [(i, t) for (i, _), t in zip(items, norm) if t]
        self.n = np.array([len(t) for _, t in self.items], np.int64)
        self.most = np.array([int(round((1 - similarity) * n, 9)) for n in self.n.tolist()], np.int64)
        self.shift = np.maximum(SHIFT, np.ceil(np.log2(self.most + 1)).astype(np.int64) - 1)
        self.least = np.where(self.n < SURE, 1, 2)
        data = [np.frombuffer(t.encode(), np.uint8) for _, t in self.items]
        rng, every = np.random.default_rng(seed), np.arange(len(data))
        spans = [(every[self.n >= MIDDLE], STEPS, STRIDE), (every[(self.n >= SHORT) & (self.n < MIDDLE)], STEPS * 2 // 3, 2)]
        self.tables = []  # (walk, stride, sorted keys, their item, their place in it, bitmap of keys)
        for own, steps, stride in spans:
            for _ in range(tables_for(similarity) if len(own) else 0):
                self._add(Walk.random(rng, steps), stride, [(k, data[k], None) for k in own.tolist()])
        pieces = {}
        for k in every[self.n < SHORT].tolist():
            text, cut = self.items[k][1], int(self.most[k]) + 1
            edges = np.linspace(0, len(text), cut + 1).astype(int).tolist()
            for lo, hi in zip(edges, edges[1:]):
                size = len(text[lo:hi].encode())
                pieces.setdefault(size, []).append((k, data[k], len(text[:lo].encode())))
        for size, own in sorted(pieces.items()):
            self._add(Walk.plain(size), 1, own)
        self.held = {}

    def _add(self, walk: Walk, stride: int, parts):
        """A table over walks from one place (or all, if None) of each part (item, bytes, place)."""
        keys, items, places, steps = [], [], [], len(walk.moves)
        for k, text, at in parts:
            start = np.arange(len(text)) if at is None else np.array([at])
            h, end = walk.keys(np.concatenate([text, np.zeros(steps, np.uint8)]), start)
            ok = end <= len(text)
            keys.append(h[ok])
            items.append(np.full(int(ok.sum()), k))
            places.append(start[ok])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        bitmap = np.zeros(1 << BITMAP, bool)
        bitmap[(key >> np.uint64(64 - BITMAP)).astype(np.intp)] = True
        self.tables.append((walk, stride, key[order], np.concatenate(items)[order], np.concatenate(places)[order], bitmap))

    def plain(self) -> dict:
        """All state as plain arrays, lists and tuples, to be broadcast: a worker needs no copy of this package."""
        state = dict(self.__dict__, held={})
        state["tables"] = [((w.moves, w.taken), *rest) for w, *rest in self.tables]
        return state

    @classmethod
    def of(cls, state: dict) -> Index:
        own = cls.__new__(cls)
        own.__dict__.update(state, held={}, tables=[(Walk(*w), *rest) for w, *rest in state["tables"]])
        return own

    def windows(self, text: np.ndarray, size: int):
        """(item, least and most byte where it may begin) of the windows of ``text`` with enough hits;
        ``text`` goes on for as many zero bytes after ``size`` as a walk has steps."""
        codes, widest = [np.zeros(0, np.int64)], int(self.shift.max())
        zero = ((max(int(t[4].max(initial=0)) for t in self.tables) >> widest) + 2) << widest  # diagonals may be negative
        region_bits = (size // REGION + 1).bit_length()
        bin_bits = ((size + zero) >> SHIFT).bit_length() + 1
        for walk, stride, keys, items, places, bitmap in self.tables:
            for lo in range(0, size, PROBES):
                at = np.arange(-(-lo // stride) * stride, min(lo + PROBES, size), stride)
                h, _ = walk.keys(text, at)
                hit = np.flatnonzero(bitmap[(h >> np.uint64(64 - BITMAP)).astype(np.intp)])
                h, at = h[hit], at[hit]
                first = np.searchsorted(keys, h)
                n = np.searchsorted(keys, h, "right") - first
                row = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                item, at = items[row], np.repeat(at, n)
                diagonal = (at - places[row] + zero) >> self.shift[item]
                codes.append(np.unique((((item << bin_bits) | diagonal) << region_bits) | (at // REGION)))
        code = np.concatenate(codes)
        # A leak's hits spread over two neighbouring bins: each bin is counted with the next.
        code = np.unique(np.concatenate([code, code - (1 << region_bits)]))
        group = code >> region_bits
        first = np.flatnonzero(np.diff(group, prepend=-1))
        group, count = group[first], np.diff(np.append(first, len(code)))
        item, bin_ = group >> bin_bits, group & ((1 << bin_bits) - 1)
        ok = count >= self.least[item]
        item, bin_ = item[ok], bin_[ok]
        new = (np.diff(item, prepend=-1) != 0) | (np.diff(bin_, prepend=-9) > 2)
        place = np.arange(len(new))
        place -= np.maximum.accumulate(np.where(new, place, 0))
        new = np.flatnonzero(place % RUN == 0)  # a run of bins is verified in parts of about the same length
        last = np.append(new[1:], len(item))[:len(new)] - 1
        item, shift = item[new], self.shift[item[new]]
        return item, (bin_[new] << shift) - zero, ((bin_[last] + 2) << shift) - zero

    def candidates(self, texts: pa.Array):
        """(text, item, first and last character) of the stretches of normalised ``texts`` to verify, and
        all their characters in a row with each text's first one."""
        texts = pc.fill_null(texts, "")
        data = "".join(texts.to_pylist()).encode()
        codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        text = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(max([STEPS, *(len(t[0].moves) for t in self.tables)]), np.uint8)])
        size = len(data)
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        begins = np.concatenate(([0], ends[:-1]))
        char = np.concatenate(([0], np.cumsum((text[:size] & 0xC0) != 0x80, dtype=np.int32)))  # characters before each byte
        first_char = np.append(char[begins], len(codes)) if len(begins) else np.zeros(1, np.int64)
        item, start, end = self.windows(text, size)
        n, d = self.n[item], self.most[item]
        start = np.maximum(0, char[np.clip(start, 0, size)] - d)
        stop = np.minimum(len(codes), char[np.clip(end, 0, size)] + n + 2 * d)
        # The texts that a stretch touches.
        lo = np.searchsorted(first_char, start, "right") - 1
        hi = np.searchsorted(first_char, stop, "left")
        many = np.maximum(0, hi - lo)
        row = np.repeat(np.arange(len(item)), many)
        doc = lo[row] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first, last = np.maximum(start[row], first_char[doc]), np.minimum(stop[row], first_char[doc + 1])
        ok = last - first >= (n - d)[row]
        return doc[ok], item[row][ok], first[ok], last[ok], codes, first_char

    def _places(self, k: int) -> np.ndarray:
        """Bit masks of item ``k``'s places per class of characters; kept while there is room."""
        got = self.held.get(k)
        if got is None:
            if sum(x.nbytes for x in self.held.values()) > 32 << 20 and len(self.held) % 64 == 0:
                self.held.clear()
            got = self.held[k] = np.zeros((CLASSES, (int(self.n[k]) + 63) // 64), np.uint64)
            c, o = np.frombuffer(self.items[k][1].encode("utf-32-le"), np.uint32) % CLASSES, np.arange(self.n[k])
            np.bitwise_or.at(got, (c.astype(np.int64), o >> 6), np.uint64(1) << (o & 63).astype(np.uint64))
        return got

    @staticmethod
    def _parts(rows: np.ndarray, limbs: int):
        """``rows`` in parts whose bit masks stay within bounds, however long the items."""
        many = max(16, min(ABREAST, (1 << 21) // (CLASSES * limbs)))
        return (rows[i:i + many] for i in range(0, len(rows), many))

    def _near(self, codes: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which stretches of ``codes`` hold a substring within the item's edits, as
        ``distances`` but for many at once, 64 bits at a time.  Characters fall into
        CLASSES, so some that don't are among them."""
        low, one, top = np.full(len(item), 1 << 40, np.int64), np.uint64(1), np.uint64(63)
        limbs = (self.n[item] + 63) // 64
        order = np.lexsort((start - end, limbs))
        for own in np.split(order, np.flatnonzero(np.diff(limbs[order])) + 1):
            for part in self._parts(own, int(limbs[own[0]]) if len(own) else 1):  # the longest first
                m, k, at, size = int(limbs[part[0]]), item[part], start[part], (end - start)[part]
                used, row = np.unique(k, return_inverse=True)
                places = np.zeros((len(used), CLASSES, m), np.uint64)
                for x, i in enumerate(used.tolist()):
                    places[x] = self._places(i)
                places, row = places.reshape(-1, m).T.copy(), row * CLASSES
                up, down = np.full((m, len(part)), ~np.uint64(0)), np.zeros((m, len(part)), np.uint64)
                far, last = self.n[k].copy(), ((self.n[k] - 1) & 63).astype(np.uint64)
                least = far.copy()
                active = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()
                for j, a in enumerate(active):
                    cell = row[:a] + codes[at[:a] + j]
                    h_up = h_down = np.uint64(0)
                    for limb in range(m):
                        eq, u, d = places[limb][cell], up[limb, :a], down[limb, :a]
                        x_v = eq | d
                        eq |= h_down
                        x = (((eq & u) + u) ^ u) | eq
                        p, q = d | ~(x | u), u & x
                        if limb == m - 1:
                            far[:a] += ((p >> last[:a]) & one).astype(np.int64) - ((q >> last[:a]) & one).astype(np.int64)
                        out = p >> top, q >> top
                        p, q = p << one | h_up, q << one | h_down
                        up[limb, :a], down[limb, :a] = q | ~(x_v | p), p & x_v
                        h_up, h_down = out
                    np.minimum(least[:a], far[:a], out=least[:a])
                low[part] = least
        return low <= self.most[item]

    def leaks_of(self, texts) -> list[list[tuple]]:
        """(item id, first word, distance) of each leaking item of each text: its nearest, then first, substring."""
        out: list[list[tuple]] = [[] for _ in texts]
        for i, k, word, far in self.found(texts):
            out[i].append((self.items[k][0], word, far))
        return out

    def found(self, texts) -> list[tuple[int, int, int, int]]:
        """(text, item's number, first word, distance), in order."""
        if not self.items or not len(texts):
            return []
        norm = normalised(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        size = np.cumsum(pc.fill_null(pc.binary_length(norm), 0).to_numpy())
        reach = int(4 * (self.n + self.most + (4 << self.shift)).max()) + 64
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        lo = 0
        while lo < len(norm):  # blocks of texts; a longer text is cut into blocks that overlap by any stretch
            before = int(size[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + BLOCK, "right")))
            if hi == lo + 1 and int(size[lo]) - before > BLOCK + reach:
                text = norm[lo].as_py()
                for at in range(0, len(text), BLOCK):
                    self._verify([lo], [at], pa.array([text[at:at + BLOCK + reach]], pa.string()), best, [text])
            else:
                self._verify(range(lo, hi), [0] * (hi - lo), norm[lo:hi], best, None)
            lo = hi
        return [(i, k, word, far) for (i, k), (far, _, word) in sorted(best.items())]

    def _verify(self, rows, offsets, texts: pa.Array, best: dict, whole):
        doc, item, first, last, codes, first_char = self.candidates(texts)
        classes = (codes % CLASSES).astype(np.uint8)
        for x in np.flatnonzero(self._near(classes, item, first, last)).tolist() if len(item) else ():
            d, k, own = int(doc[x]), int(item[x]), int(first_char[doc[x]])
            norm, most = self.items[k][1], int(self.most[k])
            text = texts[d].as_py()
            start, end = int(first[x]) - own, int(last[x]) - own
            got, stop = min(((far, j) for j, far in enumerate(distances(norm, text[start:end]), start + 1)), default=(most + 1, 0))
            i = rows[d]
            if got > most or got > best.get((i, k), (got,))[0]:
                continue
            back = text[max(0, stop - len(norm) - got):stop][::-1]
            place = stop - next(j for j, far in enumerate(distances(norm[::-1], back, True), 1) if far == got) + offsets[d]
            mine = got, place, (whole[d] if whole else text).count(" ", 0, place)
            best[i, k] = min(best.get((i, k), mine), mine)

    def leaks(self, text: str | None):
        """:meth:`leaks_of` of one text."""
        return self.leaks_of([text])[0]


def _indexes(benchmark: DataFrame, item: str, text: str, similarity: float, index_bytes: int):
    """Indexes over the items, dealt to passes by a hash so that each stays near ``index_bytes`` at most."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    passes = max(1, -(-size * 24 * tables_for(similarity) // index_bytes))  # a key, an item and a place a byte and table
    for p in range(passes):
        own = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == p)
        yield Index([(r.i, r.t) for r in own.orderBy("i", "t").toLocalIterator()], similarity), passes


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          similarity: float = 0.8, index_bytes: int = 256 << 20) -> DataFrame:
    """``(doc_id, item_id, start_word, distance, similarity)``: each leaking item of each row."""
    kind, item_type = documents.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    spark, parts = documents.sparkSession, []
    for index, passes in _indexes(benchmark, item, item_text, similarity, index_bytes):
        shared = spark.sparkContext.broadcast(index.plain())

        def run(batches, shared=shared):
            own, ids_type = Index.of(shared.value), to_arrow_type(item_type)
            for b in text_slices(batches, 1 << 13, 4 << 20):
                found = own.found(b.column(1))
                at, k, starts, far = zip(*found) if found else ((),) * 4
                yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array([own.items[i][0] for i in k], ids_type),
                                       pa.array(starts, pa.int64()), pa.array(far, pa.int64()), pa.array([1 - f / int(own.n[i]) for i, f in zip(k, far)], pa.float64())],
                                      names=["doc_id", "item_id", "start_word", "distance", "similarity"])
        found = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(released(run), f"doc_id {kind}, item_id {item_type.simpleString()}, start_word bigint, distance bigint, similarity double")
        parts.append(written(found, "leaks") if passes > 1 else found)
    return reduce(DataFrame.unionByName, parts)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          similarity: float = 0.8, index_bytes: int = 256 << 20) -> DataFrame:
    """The rows of ``documents`` without a leaking item, in place (no shuffle)."""
    for index, passes in _indexes(benchmark, item, item_text, similarity, index_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(index.plain())
        schema = documents.schema

        def run(batches, shared=shared):
            own = Index.of(shared.value)
            for b in text_slices(batches, 1 << 13, 4 << 20):
                clear = np.ones(b.num_rows, bool)
                clear[[x[0] for x in own.found(b.column(b.num_columns - 1))]] = False
                yield pa.record_batch(b.columns[:-1], names=schema.names).filter(pa.array(clear))
        documents = documents.select("*", F.col(text).cast("string").alias("_decontam_text")).mapInArrow(released(run), schema)
        if passes > 1:
            documents = written(documents, "clean")
    return documents
