"""Byte-level BPE with a public rank file: two-tier lookup, and decoding.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash; all others are
merged by a heap of adjacent pairs over a linked list of bytes.  The vocabulary (a fixed file) is
the only thing that is broadcast.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from phasegrid.llm import common as C

# Remembered pre-tokens of a worker; when it is full it starts anew, which only costs time.
# Bytes of a worker's memo of pre-tokens: two generations of half as much.
MEMO_BYTES = 48 << 20
# What an entry takes beside its strings: two object heads and a place in the table.
ENTRY_BYTES = 190
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash by displacement: n keys on n slots, and the key itself as the proof.

    A key's bucket has a displacement under which all its keys fall on free slots; a bucket of one
    key names its slot directly (stored as -slot - 1).
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        slots = [-1] * n
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                continue
            d = 0
            while True:
                places = {self._slot(hashes[i], d) for i in members}
                if len(places) == len(members) and all(slots[p] < 0 for p in places):
                    break
                d += 1
            self.shift[bucket] = d
            for i in members:
                slots[self._slot(hashes[i], d)] = i
        free = iter([s for s in range(n) if slots[s] < 0])
        for bucket, members in groups.items():
            if len(members) == 1:
                slot = next(free)
                self.shift[bucket] = -slot - 1
                slots[slot] = members[0]
        self.rank = slots
        self.keys = [keys[i] for i in slots]

    def _slot(self, h: int, d: int) -> int:
        x = (h + d * 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
        return (x ^ (x >> 32)) % self.n

    def get(self, key: bytes) -> int:
        """Rank of a key, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.rank[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank (leftmost first) merges until none is left."""
    n = len(piece)
    after = list(range(1, n + 2))  # start of the node to the right; 0 marks a node merged away
    after[n] = 0
    before = list(range(-1, n))
    find = ranks.get
    # A heap entry is one number, which compares faster than a tuple: rank, start and end of the pair.
    bits = n.bit_length()
    low, high = (1 << bits) - 1, 2 * bits
    heap = [r << high | i << bits | i + 2 for i in range(n - 1) if (r := find(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, end = entry >> bits & low, entry & low
        mid = after[i]
        if not mid or after[mid] != end:
            continue
        after[i], after[mid] = end, 0
        before[end] = i
        if end < n:
            right = after[end]
            r = find(piece[i:right])
            if r is not None:
                heappush(heap, r << high | i << bits | right)
        left = before[i]
        if left >= 0:
            r = find(piece[left:end])
            if r is not None:
                heappush(heap, r << high | left << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern over a text.

    ``regex`` knows classes like ``\\p{L}``, but takes twice the time of ``re``.  So a pattern of plain
    characters, ``\\p{..}``, ``\\s`` and ``\\S`` is also compiled for ``re``, with the characters that
    ``regex`` finds in the classes written out; texts beyond the first plane go to ``regex``.
    """
    slow = regex.compile(pattern).findall
    named = r"\\p\{\w+\}|\\[sS]"
    if not re.fullmatch(rf"(?:{named}|\[\^?(?:{named}|[\w ])+\]|\(\?[!=:]|[\w '|?+*)])+", pattern):
        return slow
    plane = "".join(map(chr, range(1 << 16)))
    chars = {
        name: "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{name}+", plane))
        for name in set(re.findall(named, pattern))
    }
    if not all(chars.values()):
        return slow

    def written_out(part: re.Match) -> str:
        return re.sub(named, lambda name: chars[name[0]], part[0] if part[0][0] == "[" else f"[{part[0]}]")

    fast = re.compile(re.sub(rf"\[[^]]*\]|{named}", written_out, pattern)).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: fast(text) if text.isascii() or not beyond(text) else slow(text)


class Codec(dict):
    """Encoder and decoder of one worker; as a dict it remembers the packed ids of pre-tokens.

    The memo is bounded by bytes: a full generation becomes the older one, whose entries come back
    as they are used again.
    """

    def __init__(self, tokens: list[bytes], pattern: str, limit: int = MEMO_BYTES):
        super().__init__()
        self.tokens, self.limit = pa.array(tokens, pa.large_binary()), limit // 2
        self.held, self.older = 0, {}
        self.split = splitter(pattern)

    # Made when the first text is encoded: a worker that only decodes needs neither.
    @cached_property
    def whole(self) -> PerfectHash:
        return PerfectHash(self.tokens.to_pylist())

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens.to_pylist())}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = self.older.get(piece)
        if ids is None:
            rank = self.whole.get(raw)
            ids = array("I", [rank] if rank >= 0 else merge(raw, self.ranks)).tobytes()
        if len(raw) <= 64:
            if self.held >= self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
            self.held += ENTRY_BYTES + len(raw) + len(ids)
        return ids

    def forget(self) -> None:
        """Empty the memo, so that a worker that goes on to other work does not hold it."""
        self.clear()
        self.older, self.held = {}, 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode_rows(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The bytes of each row's ids; row i has ids off[i] to off[i + 1]."""
        if not len(ids):
            return pa.array([b""] * (len(off) - 1), pa.binary())
        found = self.tokens.take(pa.array(ids))
        _, ends, body = found.buffers()
        ends = np.frombuffer(ends, np.int64)[found.offset : found.offset + len(ids) + 1]
        return pa.Array.from_buffers(
            pa.large_binary(), len(off) - 1, [None, pa.py_buffer(ends[off]), body]
        ).cast(pa.binary())

    def decode(self, ids: bytes) -> bytes:
        return self.decode_rows(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))[0].as_py()


_CODECS: dict[tuple, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """The codec of this worker process, made once for each vocabulary."""
    tokens = shared.value
    key = (len(tokens), pattern, xxhash.xxh3_64_intdigest(b"\n".join(tokens)))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of each row and ``ids_col``, the token ids of the whole
    text as binary little-endian unsigned 32-bit integers (``id_lists`` turns them into arrays).

    A null or empty text has no ids.  No special tokens: their strings are ordinary text.  Bytes
    that are not UTF-8 count as U+FFFD.  A column named ``ids_col`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [c for c in (df.columns if keep is None else keep) if c != ids_col]
    source = df.select(*kept, F.col(text_col).cast("binary").alias("_text"))
    schema = df.select(*kept, F.lit(b"").alias(ids_col)).schema

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            texts = batch.column(len(kept))
            for lo in range(0, max(len(texts), 1), 1000):
                ids = [codec.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts.slice(lo, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, 1000).columns[: len(kept)], pa.array(ids, pa.binary())], schema.names
                )
        codec.forget()

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``out_col``, the bytes of the ids; null ids give none."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [c for c in (df.columns if keep is None else keep) if c != out_col]
    source = df.select(*kept, F.col(ids_col).alias("_ids"))
    schema = df.select(*kept, F.lit(b"").alias(out_col)).schema

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            ids = batch.column(len(kept))
            for lo in range(0, len(ids), 1000):
                for first, end, data, off in C.text_slices(ids.slice(lo, 1000)):
                    out = codec.decode_rows(np.frombuffer(data.tobytes(), "<u4"), off // 4)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(lo + first, end - first).columns[: len(kept)], out], schema.names
                    )

    return source.mapInArrow(run, schema)


def id_lists(df: DataFrame, ids_col: str = "ids", out_col: str = "id_list") -> DataFrame:
    """All columns and ``out_col``, the packed ids as array<int>; null ids give an empty array."""
    kept = [c for c in df.columns if c != out_col]
    schema = df.select(*kept, F.array().cast("array<int>").alias(out_col)).schema
    at = kept.index(ids_col)

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at).cast(pa.large_binary()).fill_null(b"").to_pylist()
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], schema.names)

    return df.select(*kept).mapInArrow(run, schema)
