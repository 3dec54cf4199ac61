"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are cut into pre-tokens.  A block of texts (at most ``BLOCK`` bytes,
   or one longer text) keeps its pre-tokens in order, as positions in the
   block's list of distinct words, and sends each distinct word once.
2. Words are shuffled by their hash, so all blocks' copies of a word meet in
   one task, which encodes each distinct word once, whatever its frequency: a
   hot word is one entry per block.
3. Ids go back to the blocks (join on the block) and are put together by
   position.  Decoding joins ids with the token-byte table, which has one row
   per rank of the tokenizer (a fixed bound), independent of the words.

Words and ids travel packed, one row per (block, share of the hash).

Null texts are empty texts; empty texts have no ids; repeated rows and equal
keys are separate rows of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuskit.session import ensure_checkpoint_dir
from corpuskit.llm.common import released, text_slices

BLOCK = 24 << 20
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# The classes of the public pattern for code points below U+0250.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x09-\x0d\x20\x85\xa0"


def splitter() -> Callable[[str], list[str]]:
    """The public pattern's matches in order.  Texts below U+0250 take the
    standard library's engine with the classes spelled out, others the full one
    (white space is Unicode's property, as the tokenizer library has it)."""
    import regex
    full = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    near = re.compile(public_tokenizers.PATTERN.replace(r"\p{L}", _L).replace(r"\p{N}", _N).replace(r"[^\s", f"[^{_S}")
                      .replace(f" ?{_L}+", f" ?[{_L}]+").replace(f" ?{_N}+", f" ?[{_N}]+")
                      .replace(r"(?!\S)", f"(?![^{_S}])").replace(r"\s", f"[{_S}]"))
    far = re.compile(r"[^\x00-ɏ]").search
    return lambda text: (full if far(text) else near).findall(text)


def ranks(path: str = PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def word_encoder(path: str = PATH) -> Callable[[bytes], list[int]]:
    """The merge rule on one pre-token, by the tokenizer library."""
    import tiktoken
    core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return lambda word: core._encode_single_piece(word)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(shares: int):
    """Rows ``(block, share, keys, payload, sizes, more)``: share -1 has the
    positions; share s the words whose hash falls to it, and their places."""
    def run(batches):
        split = splitter()
        for b in text_slices(batches, 1 << 30, BLOCK):
            block, places, counts, seq = uuid.uuid4().hex, {}, [], array("I")
            for t in b.column(1).to_pylist():
                words = split(t) if t else ()
                seq.extend([places.setdefault(w, len(places)) for w in words])
                counts.append(len(words))
            words = [w.encode() for w in places]
            own = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=4).digest()) % shares for w in words), np.int64, len(words))
            order, rows = np.argsort(own, kind="stable"), [(block, -1, b.column(0).to_pylist(), _pack(np.frombuffer(seq, np.uint32)), _pack(np.array(counts)), None)]
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(words) else ():
                ws = [words[i] for i in part.tolist()]
                rows.append((block, int(own[part[0]]), None, zstandard.compress(b"".join(ws), 3), _pack(np.array([len(w) for w in ws])), _pack(part)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.string(), pa.int32(), pa.list_(b.column(0).type), pa.binary(), pa.binary(), pa.binary()))],
                names=["block", "share", "keys", "payload", "sizes", "more"])
    return run


def _encode_words(path: str):
    """Each task holds whole shares: every distinct word in it is encoded once."""
    def run(batches):
        encode, known = word_encoder(path), {}
        for b in batches:
            out = []
            for data, sizes, places in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                data, at, ids = zstandard.decompress(data), 0, []
                for n in _unpack(sizes).tolist():
                    w = data[at:at + n]
                    at += n
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids.append(got)
                out.append((_pack(np.concatenate(ids)), _pack(np.fromiter(map(len, ids), np.int64, len(ids))), places))
            yield pa.record_batch([b.column(0), *[pa.array(c, pa.binary()) for c in (zip(*out) if out else ((), (), ()))]],
                                  names=["block", "ids", "lens", "places"])
    return run


def _reassemble(finish, fields, schema_of):
    def run(batches):
        emit = finish()
        for b in batches:
            for row in b.to_pylist():
                shares = [tuple(_unpack(x[k]) for k in ("ids", "lens", "places")) for x in row["words"] or ()]
                seq, counts = _unpack(row["payload"]), _unpack(row["sizes"])
                n = sum(len(p) for _, _, p in shares)
                lens, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
                flat = np.concatenate([ids for ids, _, _ in shares]) if shares else np.zeros(0, np.uint32)
                base = 0
                for ids, ls, places in shares:
                    lens[places] = ls
                    starts[places] = base + np.cumsum(ls, dtype=np.int64) - ls
                    base += len(ids)
                out, at = [], 0
                for c in counts.tolist():
                    w = seq[at:at + c]
                    at += c
                    ln = lens[w]
                    ends = np.cumsum(ln)
                    total = int(ends[-1]) if c else 0
                    out.append(emit(flat[np.repeat(starts[w] - ends + ln, ln) + np.arange(total)]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip((row["keys"], *zip(*out)), schema_of)], names=["doc_id", *fields])
    return run


def ids_of():
    """Finish: the ids themselves and their number."""
    return lambda ids: (len(ids), ids.astype(np.int32))


def digests_of(path: str = PATH):
    """Finish: number and hash of the ids; hash of the bytes that the token-byte
    table gives for them."""
    def make():
        table = {i: t for t, i in ranks(path).items()}
        join = table.__getitem__
        sha = hashlib.sha256
        return lambda ids: (len(ids), sha(ids.astype("<u4").tobytes()).hexdigest(), sha(b"".join(map(join, ids.tolist()))).hexdigest())
    return make


def ids_and_decoded(path: str = PATH):
    """Finish: number of the ids, the ids, and the hash of the bytes that they decode to."""
    def make():
        digest = digests_of(path)()
        return lambda ids: (len(ids), ids.astype(np.int32), digest(ids)[2])
    return make


IDS = (ids_of, {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}, "n_tokens bigint, ids array<int>")
DIGESTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = PATH, finish=None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row, or what ``finish`` makes of the
    ids (a factory, its Arrow fields and their DDL)."""
    spark = documents.sparkSession
    make, fields, ddl = finish or IDS
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema[key].dataType.simpleString()
    key_type = to_arrow_type(documents.schema[key].dataType)
    raw = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")) \
        .mapInArrow(released(_blocks(shares)), f"block string, share int, keys array<{kind}>, payload binary, sizes binary, more binary")
    # Written in buckets of the block, so that positions needn't be shuffled to meet their ids.
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    raw.write.bucketBy(shares, "block").option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    raw = spark.table(name)
    words = raw.where("share >= 0").select("block", "share", "payload", "sizes", "more").repartition(shares, "share") \
        .mapInArrow(released(_encode_words(path)), "block string, ids binary, lens binary, places binary")
    back = words.repartition(shares, "block").groupBy("block").agg(F.collect_list(F.struct("ids", "lens", "places")).alias("words"))
    blocks = raw.where("share = -1").select("block", "keys", "payload", "sizes").join(back, "block", "left")
    spark.sql(f"DROP TABLE {name}")  # from the catalog only: the files are outside its warehouse
    return blocks.mapInArrow(released(_reassemble(make, tuple(fields), (key_type, *fields.values()))), f"doc_id {kind}, {ddl}")


def round_trip(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = PATH) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row."""
    return encode(documents, key, text, path, (digests_of(path), DIGESTS, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def encode_and_decode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = PATH) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)`` for every row: the ids and the hash of what they decode to."""
    fields = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded_sha256": pa.string()}
    return encode(documents, key, text, path, (ids_and_decoded(path), fields, "n_tokens bigint, ids array<int>, decoded_sha256 string"))


def decode(encoded: DataFrame, path: str = PATH, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of rows with ids: ids joined with the token-byte table
    (one row per rank).  An id without a row gives NULL; NULL ids give NULL."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        table = {i: t for t, i in ranks(path).items()}
        for b in batches:
            texts = [None if x is None or any(i not in table for i in x) else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace")
                     for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("_ids")).mapInArrow(released(run), f"doc_id {kind}, text string")
