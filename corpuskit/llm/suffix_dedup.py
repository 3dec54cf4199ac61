"""Repeated-substring removal with suffix arrays by linear grouping.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(in a document with a smaller id, or earlier in the same document), judged on
the input.

Suffix arrays of the whole corpus don't split over tasks, but equal windows of
LENGTH bytes do: every window has an anchor, its smallest-hashed gram of
``GRAM`` bytes (the first of equal ones), which depends on the window's bytes
alone, so equal windows have equal anchors at equal places.  A document is a
chain of anchors, each with a context: the bytes of the windows that share it.

1. Anchors are counted by hash; those that occur once have no equal window
   anywhere.  (8 bytes an anchor are shuffled, pre-aggregated.)
2. Occurrences of repeated anchors carry a hash of their context.  Contexts
   equal to an earlier one are repeated as a whole: found by the first
   occurrence of each (anchor, context), an aggregate, joined back.
3. Anchors whose first occurrences have several different contexts are dealt
   to tasks, which build suffix arrays over blocks of such contexts and read
   off the windows that have an equal one earlier.
4. Repeated runs are joined with the texts and cut out.

The suffix array is built without recursion or renaming (Baier 2016).  The
Lyndon prefix of a suffix reaches to its next smaller suffix.  Groups of
suffixes with equal prefixes are processed in descending order; each member's
previous-smaller pointer names the suffix whose prefix it extends, which moves
to a higher group next to its old one.  Then, from the smallest suffix on, the
pointers' chains emit each group in order.  Both phases are linear.

Before that, an anchor's windows are halved ``HALVINGS`` times by their distance
from it: those of a quarter share a core of 83 bytes or more, contexts whose core
nobody else has can't hold an equal window, and equal quarters are repeated as a
whole.  Anchors with more than ``CROWD`` different
first contexts (a common line in many surroundings) are never put into one
task: their halves are dealt by core as anchors of their own, and halved again
while a core is still crowded; equal halves fall together at each step, and a
core of LENGTH bytes is a window, so this ends after seven steps.

Null texts are empty; texts shorter than LENGTH lose nothing; rows that share
an id are one document: none is earlier than the other at equal places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import text_slices, texts_of, written

LENGTH, GRAM = 100, 32
CROWD = 256
HALVINGS = 2  # of an anchor's windows before a suffix array reads what is left
BLOCK = 1 << 15  # bytes of contexts in one suffix array, or one anchor's
PIECE = 1 << 22
KNOWN = 4 << 20  # anchors (8 bytes each) that are broadcast to save shuffling, at most
_IDX = np.uint64((1 << 24) - 1)


def _table(seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of every gram of GRAM = 2^k bytes, by doubling."""
    h, n = table[data], 1
    while n < GRAM:
        a, b = h[:-n], h[n:]
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def anchors(data: np.ndarray, table: np.ndarray):
    """(hash, anchor, first window, windows) of the anchors of one piece of a text."""
    n = len(data) - LENGTH + 1
    h = gram_hashes(data, table)
    low = (h & ~_IDX) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= LENGTH - GRAM + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = LENGTH - GRAM + 1 - span
    low = np.minimum(low[:n], low[rest:rest + n])
    at = (low & _IDX).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]].view(np.int64), at[first], first, np.diff(np.append(first, n))


def pieces(text: bytes):
    """(start, bytes) of pieces whose windows make up the text's."""
    for lo in range(0, max(0, len(text) - LENGTH + 1), PIECE):
        yield lo, text[lo:lo + PIECE + LENGTH - 1]


def suffix_array(s: bytes) -> list[int]:
    """Suffix array by linear grouping (see the module's text)."""
    n = len(s)
    if n == 0:
        return []
    # Groups are ranges of ``sa``; a group is known by its first place there.
    counts = [0] * 257
    for c in s:
        counts[c + 1] += 1
    for c in range(256):
        counts[c + 1] += counts[c]
    free, sa, at, group, size = counts[:256], [0] * n, [0] * n, [0] * n, [0] * n
    for i, c in enumerate(s):
        p = free[c]
        free[c] = p + 1
        sa[p], at[i], group[i] = i, p, counts[c]
        size[counts[c]] += 1
    before = [-1] * n  # previous suffix of a lower group
    end = n
    while end:
        start = group[sa[end - 1]]
        members = sa[start:end]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        end = start
        if not times:
            continue
        if len(times) == 1:
            by_times = [list(times)]
        else:
            by = {}
            for p, t in times.items():
                by.setdefault(t, []).append(p)
            by_times = [by[t] for t in sorted(by, reverse=True)]
        # Those that more members extend come last within their old group.
        for ps in by_times:
            moved: dict[int, int] = {}
            for p in ps:
                g = group[p]
                size[g] -= 1
                to, was = g + size[g], at[p]
                other = sa[to]
                sa[to], sa[was], at[p], at[other] = p, other, to, was
                moved[g] = to
            for p in ps:
                to = moved[group[p]]
                size[to] += 1
                group[p] = to
    out, fill, placed = [0] * n, list(range(n)), [False] * n
    order, k = n, 0
    while True:
        p = order - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[fill[g]] = p
            fill[g] += 1
            placed[p] = True
            p = before[p]
        if k == n:
            return out
        order = out[k]
        k += 1


# A place in one long: first window's start, anchor's distance from it and number
# of windows (7 bits each).  Beside it stands ``mark``, a 64-bit hash of the whole
# text, which tells rows of one id apart.
def _place(start, lo, n):
    return (start << 14) | (lo << 7) | n


def _each_anchor(batches, table, own=None):
    """Per slice: (row, hash, piece start, piece, anchors, firsts, windows) of each piece."""
    for b in text_slices(batches):
        for i, t in enumerate(texts_of(b)):
            for lo, piece in pieces(t):
                h, a, f, n = anchors(np.frombuffer(piece, np.uint8), table)
                yield b, i, lo, piece, h, a, f, n
        yield b, None, 0, b"", None, None, None, None


def _counts(batches):
    """(h, n) of the anchors, added up per slice."""
    table, got = _table(), []
    for _, i, _, _, h, *_ in _each_anchor(batches, table):
        if i is not None:
            got.append(h)
        elif got:
            hs, n = np.unique(np.concatenate(got), return_counts=True)
            got = []
            yield pa.record_batch([pa.array(hs), pa.array(n)], names=["h", "n"])


def _occurrences(known):
    """(h, ctx, doc, mark, place, late) of repeated anchors; ``late``: the slice has
    the same context at an earlier place, so a hot one is a row per slice."""
    def run(batches):
        table, got, keep = _table(), [], None if known is None else known.value
        for b, i, lo, piece, h, a, f, n in _each_anchor(batches, table):
            if i is not None:
                if keep is not None:
                    at = np.minimum(np.searchsorted(keep, h), max(0, len(keep) - 1))
                    own = keep[at] == h if len(keep) else np.zeros(len(h), bool)
                    h, a, f, n = h[own], a[own], f[own], n[own]
                digest = xxhash.xxh64_intdigest
                ctx = np.array([digest(piece[s:s + m + LENGTH - 1], k) for s, k, m in zip(f.tolist(), (a - f).tolist(), n.tolist())], np.uint64)
                doc, mark = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                got.append((h, ctx.view(np.int64), np.full(len(h), doc), np.full(len(h), mark), _place(f + lo, a - f, n)))
            elif got:
                h, ctx, doc, mark, place = map(np.concatenate, zip(*got))
                got = []
                order = np.lexsort((place, doc, ctx, h))
                h, ctx, doc, mark, place = h[order], ctx[order], doc[order], mark[order], place[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))
                first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
                late = (doc > doc[first]) | (place >> 14 > place[first] >> 14)
                yield pa.record_batch([pa.array(c) for c in (h, ctx, doc, mark, place, late)], names=["h", "ctx", "doc", "mark", "place", "late"])
    return run


def _contexts(batches):
    """(h, crowd, doc, mark, place, bytes) of the places wanted from each text;
    of equal rows side by side, from the first."""
    last = None
    for b in text_slices(batches):
        out = []
        for doc, mark, wanted, t in zip(*(b.column(c).to_pylist() for c in range(3)), texts_of(b)):
            if (doc, mark) == last:
                continue
            last = doc, mark
            for w in wanted:
                s, n = w["place"] >> 14, w["place"] & 127
                out.append((w["h"], w["crowd"], 0, LENGTH - GRAM, doc, mark, w["place"], t[s:s + n + LENGTH - 1]))
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 8, kinds)], names=["h", "crowd", "near", "far", "doc", "mark", "place", "data"])


def halves(near: int, far: int, place: int, data: bytes):
    """A context's windows that start ``near`` to ``far`` bytes before its
    anchor, halved by that distance: (core, near, far, place, bytes) of each half
    that has windows; the core is what all windows of such a half hold."""
    start, lo, n = place >> 14, (place >> 7) & 127, place & 127
    mid = (near + far + 1) // 2
    for a, b in ((near, mid - 1), (mid, far)) if near < far else ((near, far),):
        first, last = min(b, lo), max(a, lo - n + 1)
        if first >= last:
            at = lo - first
            m = first - last + 1
            yield xxhash.xxh64_intdigest(data[lo - a:lo - b + LENGTH], a << 8 | b) - (1 << 63), a, b, _place(start + at, first, m), data[at:at + m - 1 + LENGTH]


def _halved(batches):
    """(h, near, far, ctx, doc, mark, place, bytes) of the halves of crowded contexts; ``h`` is their core's hash."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for b in batches:
        out = [(h, a, z, xxhash.xxh64_intdigest(part, (p >> 7) & 127) - (1 << 63), doc, mark, p, part)
               for near, far, doc, mark, place, data in zip(*(b.column(c).to_pylist() for c in ("near", "far", "doc", "mark", "place", "data")))
               for h, a, z, p, part in halves(near, far, place, data)]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 8, kinds)], names=["h", "near", "far", "ctx", "doc", "mark", "place", "data"])


def late_windows(contexts: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(doc, start, mark) of windows of ``contexts`` (doc, mark, place, windows, bytes)
    that have an equal one earlier, by one suffix array over all of them."""
    data, owner, starts = b"".join(c[4] for c in contexts), [], []
    at = 0
    for k, (_, _, _, n, c) in enumerate(contexts):
        starts.append(at)
        owner += [k] * n + [-1] * (len(c) - n)
        at += len(c)
    out, run, last = [], [], None

    def close():
        if len(run) > 1:
            low = min(run)[:2]
            out.extend((d, s, m) for d, s, m in run if (d, s) > low)
    for p in suffix_array(data):
        k = owner[p]
        if k < 0:
            continue
        w = data[p:p + LENGTH]
        if w != last:
            close()
            run, last = [], w
        doc, mark, place, _, _ = contexts[k]
        run.append((doc, (place >> 14) + p - starts[k], mark))
    close()
    return out


def partners(contexts):
    """What of one anchor's ``contexts`` (near, far, doc, mark, place, bytes) needs
    a suffix array, and what is late already: (contexts, late places).

    The windows are halved HALVINGS times as those of crowded anchors are.  Halves
    whose core no other half has hold no equal window; a half equal to an earlier
    one is late as a whole."""
    late, groups = [], [contexts]
    for _ in range(HALVINGS):
        cores: dict[int, list] = {}
        for own in groups:
            for near, far, doc, mark, place, data in own:
                for core, a, z, p, part in halves(near, far, place, data):
                    cores.setdefault(core, []).append((a, z, doc, mark, p, part))
        groups = []
        for own in cores.values():
            if len(own) == 1:
                continue
            first: dict[tuple, tuple] = {}
            for _, _, doc, _, p, part in own:
                same, at = ((p >> 7) & 127, part), (doc, p >> 14)
                if same not in first or at < first[same]:
                    first[same] = at
            kept = []
            for c in own:
                _, _, doc, mark, p, part = c
                low = first[(p >> 7) & 127, part]
                if doc > low[0] or p >> 14 > low[1]:
                    late.append((doc, mark, p))
                else:
                    kept.append(c)
            if len(first) > 1:
                groups.append(kept)
    return [(doc, mark, p, p & 127, part) for own in groups for _, _, doc, mark, p, part in own], late


def _suffix_blocks(batches):
    """Late windows, block after block; rows come sorted by anchor, and a block holds whole anchors."""
    def flush(block, late):
        got = late_windows(block)
        doc, start, mark = (np.array(x, np.int64) for x in (zip(*got) if got else ((), (), ())))
        docs, marks, places = (np.array(x, np.int64) for x in (zip(*late) if late else ((), (), ())))
        return pa.record_batch([pa.array(np.concatenate(c)) for c in ((doc, docs), (mark, marks), (_place(start, 0, 1), places))], names=["doc", "mark", "place"])

    block, late, size, anchor, last = [], [], 0, [], None
    for b in batches:
        for h, *row in zip(*(c.to_pylist() for c in b.columns)):
            if h != last:
                more, whole = partners(anchor)
                anchor, last = [], h
                block += more
                late += whole
                size += sum(len(c[4]) for c in more)
                if size >= BLOCK or len(late) >= BLOCK:
                    yield flush(block, late)
                    block, late, size = [], [], 0
            anchor.append(row)
    more, whole = partners(anchor)
    if block or late or more or whole:
        yield flush(block + more, late + whole)


def _crowds(level: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One halving of crowded anchors' contexts: (late places, contexts of cores
    with some partners, contexts of cores still crowded)."""
    rows = written(level.mapInArrow(_halved, "h bigint, near int, far int, ctx bigint, doc bigint, mark bigint, place bigint, data binary"), "suffix-halves")
    firsts = written(rows.groupBy("h", "ctx").agg(F.min(F.struct("doc", "place", "mark")).alias("f"), F.count("*").alias("n")), "suffix-half-firsts")
    # A core with a single context that occurs once holds nothing.
    shared = firsts.groupBy("h").agg(F.count("*").alias("contexts"), F.max("n").alias("most")).where("contexts > 1 OR most > 1").drop("most")
    both = rows.join(written(firsts.join(shared, "h").drop("n"), "suffix-half-shared"), ["h", "ctx"])
    late = both.where("doc > f.doc OR shiftright(place, 14) > shiftright(f.place, 14)").select("doc", "mark", "place")
    own = both.where("contexts > 1 AND doc = f.doc AND place = f.place AND mark = f.mark").dropDuplicates(["h", "ctx"])
    own = written(own.select("h", "near", "far", "doc", "mark", "place", "data", (F.col("contexts") > CROWD).alias("crowd")), "suffix-half-contexts")
    return late, own.where("NOT crowd").drop("crowd"), own.where("crowd").drop("crowd")


def repeated_places(docs: DataFrame) -> DataFrame:
    """``(doc, mark, place)`` of runs of windows that have an equal one earlier, of rows ``(doc, mark, text)``."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    known = written(counts.where("n > 1").select("h"), "suffix-known")
    n = known.count()
    if n > KNOWN:  # all occurrences are shuffled then; nothing else changes
        shared = None
    else:
        shared = spark.sparkContext.broadcast(np.sort(known.toArrow().column("h").to_numpy()))
    found = docs.select("doc", "mark", "text").mapInArrow(_occurrences(shared), "h bigint, ctx bigint, doc bigint, mark bigint, place bigint, late boolean")
    found = found.selectExpr("*", "min(struct(doc, place)) OVER (PARTITION BY h, ctx, IF(late, doc, NULL), IF(late, place, NULL)) AS first")
    found = written(found.selectExpr("h", "ctx", "doc", "mark", "place", "late OR doc > first.doc OR shiftright(place, 14) > shiftright(first.place, 14) AS late"), "suffix-places")
    firsts = found.where("NOT late").groupBy("h", "ctx").agg(F.min(F.struct("doc", "place", "mark")).alias("p")).select("h", "p.doc", "p.mark", "p.place")
    firsts = written(firsts, "suffix-firsts")
    several = firsts.groupBy("h").count().where("count > 1").select("h", (F.col("count") > CROWD).alias("crowd"))
    wanted = firsts.join(written(several, "suffix-several"), "h") \
        .groupBy("doc", "mark").agg(F.collect_list(F.struct("h", "crowd", "place")).alias("wanted"))
    contexts = docs.join(wanted, ["doc", "mark"]).select("doc", "mark", "wanted", "text") \
        .mapInArrow(_contexts, "h bigint, crowd boolean, near int, far int, doc bigint, mark bigint, place bigint, data binary")
    contexts = written(contexts, "suffix-contexts")
    late, small, level = found.where("late").select("doc", "mark", "place"), contexts.where("NOT crowd").drop("crowd"), contexts.where("crowd").drop("crowd")
    while not level.isEmpty():
        more, few, level = _crowds(level)
        late, small = late.unionByName(more), small.unionByName(few)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = small.select("h", "near", "far", "doc", "mark", "place", "data").repartition(parts, "h").sortWithinPartitions("h")
    return late.unionByName(sorted_.mapInArrow(_suffix_blocks, "doc bigint, mark bigint, place bigint"))


def merged(places) -> list[tuple[int, int]]:
    """Maximal (start, end) byte runs that the places' windows cover."""
    p = np.sort(np.asarray(places, np.int64))
    lo = p >> 14
    hi = np.maximum.accumulate(lo + (p & 127) + LENGTH - 1) if len(p) else lo
    new = np.concatenate(([True], lo[1:] > hi[:-1])) if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return list(zip(lo[at].tolist(), hi[np.append(at[1:] - 1, len(p) - 1)].tolist())) if len(p) else []


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row; ``kept``: the
    bytes that stay, in order."""
    none = -(1 << 63)
    docs = documents.select(F.coalesce(F.col(key).cast("bigint"), F.lit(none)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .select("doc", F.xxhash64("text").alias("mark"), "text")
    runs = repeated_places(docs).groupBy("doc", "mark").agg(F.collect_set("place").alias("places"))  # equal rows have equal places

    def cut(batches):
        for b in text_slices(batches):
            out = []
            for places, t in zip(b.column(1).to_pylist(), texts_of(b)):
                spans, kept, at = merged(places or ()), [], 0
                for lo, hi in spans:
                    kept.append(t[at:lo])
                    at = hi
                kept = b"".join([*kept, t[at:]])
                out.append((len(t), len(t) - len(kept), len(spans), kept))
            yield pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                                  names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])
    out = docs.join(runs, ["doc", "mark"], "left").select("doc", "places", "text").mapInArrow(
        cut, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.nullif("doc", F.lit(none)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
