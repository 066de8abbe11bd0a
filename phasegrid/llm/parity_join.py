"""Exact self-join of documents by the Jaccard similarity of their word shingles (parity sketches).

A document's shingle hashes are XORed into the blocks of a bit sketch.  Two sketches differ in no
more blocks (or bits) than the symmetric difference of the sets, and a Jaccard similarity of at
least 3/4 bounds that difference by (a + b) / 7 <= n / 3.  So, in any common order of the non-empty
blocks, two linked documents share one of their first n / 3 + 1 blocks: those are the join keys,
made for each size band a document can meet a partner in.

1. classes: documents with equal sets share a class, so copies never meet each other as pairs.
2. keys: blocks go, packed by slice of documents, to buckets of a key range; a fixed-size count
   sketch puts very common blocks last in the order, so that passages many documents share are
   hardly ever keys.
3. groups: classes that share a key; equal groups are kept once.
4. families: inside a group, folded sketches whose Hamming distance exceeds the bound part classes;
   what stays connected is a family.
5. verification: exact set similarity inside each family; components of the links.

Groups and families larger than one task are cut into chunks that share some members; what the
chunks leave apart is cut into chunks too, each of which meets every chunk of the group in a task of
its own, so no link is lost and no group is ever whole in one task.  Nothing but the 4 MB count sketch is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from phasegrid.llm import common as C
from phasegrid.llm.graph import components
from phasegrid.sources import storage

WORDS = 5
# Bits of the count sketch's cells, and the count from which a cell is common.
CELL_BITS = 22
COMMON = 16
# A key that more classes than this share is dealt over several tasks.
SPLIT = 1 << 18
KEYS_PER_BUCKET = 1_000_000
# Members and payload bytes of a chunk, and members that chunks of one group share.
CHUNK_MEMBERS, CHUNK_BYTES, SHARED_MEMBERS = 2048, 24 << 20, 64

_U = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice, and their offsets."""
    starts, ends, words = C.word_spans(data, off)
    hashes = C.span_hashes(data, starts, ends, C.FOLDED_HASH)
    runs, _, row = C.run_hashes(hashes, words, WORDS)
    n = np.diff(words)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):  # the whole sequence as one shingle; its length keeps it apart
        whole = np.concatenate([
            C.mix(np.bitwise_xor.reduce(C.mix(hashes[words[r] : words[r + 1]] + np.arange(1, n[r] + 1, dtype=_U) * C.BASE), keepdims=True)
                  + n[r : r + 1].astype(_U)) for r in short])
        runs, row = np.concatenate([runs, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        runs, row = runs[order], row[order]
    at = np.searchsorted(row, np.arange(len(n) + 1))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        runs[lo:hi].sort()
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    return runs[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def class_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit fingerprint of each set (0 for the empty one)."""
    total = np.concatenate([[_U(0)], np.cumsum(C.mix(sets ^ _U(0xA0761D6478BD642F)), dtype=_U)])
    n = np.diff(at)
    out = C.mix((total[at[1:]] - total[at[:-1]]) + n.astype(_U) * C.BASE)
    out[n == 0] = 0
    return out.view(np.int64)


def bands_of(n: np.ndarray) -> np.ndarray:
    """Band k holds sizes 4**k to 4**(k + 1) - 1."""
    return np.searchsorted(4 ** np.arange(1, 20, dtype=np.int64), n, "right")


def blocks(sets: np.ndarray, at: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty sketch blocks of each set (offsets ``at``) in the given band.

    A band has as many blocks as its largest size, small bands 2**32; a key is the block's number
    and the XOR of the hashes that fall into it.
    """
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    width = np.where(band < 3, _U(1 << 32), _U(4) ** (band + 1).astype(_U))
    block = ((sets >> _U(32)) * width[row]) >> _U(32)
    if len(sets) == 0:
        return sets, at
    first = np.ones(len(sets), bool)
    first[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    parity = np.bitwise_xor.reduceat(C.mix(sets), begin)
    own = row[begin]
    keys = C.mix(parity ^ C.mix(block[begin] * _U(64) + band[own].astype(_U)))
    return keys >> _U(8), np.searchsorted(own, np.arange(len(n) + 1))


def band_plan(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, band, most differing blocks) for a set's own band and, where a smaller partner can
    lie in it, the band below."""
    band = bands_of(n)
    own = np.flatnonzero(n > 0)
    low = 4**band
    under = np.flatnonzero((n > 0) & (band > 0) & (3 * n <= 4 * (low - 1)))
    return [(own, band[own], n[own] // 3), (under, band[under] - 1, (n[under] + low[under] - 1) // 7)]


def _pick(sets: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = at[rows + 1] - at[rows]
    begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return sets[np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(at[rows], n)], begin


def _fingerprints(df: DataFrame, path: str) -> DataFrame:
    """doc_id, cls, n and sketch of each document, and (cell, hits) rows of the count sketch, in one
    table."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int32)
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, off in C.text_slices(batch.column(1)):
                sets, at = shingle_sets(data, off)
                cls, n = class_ids(sets, at), np.diff(at)
                _, fresh = np.unique(cls, return_index=True)
                fresh = np.array([i for i in fresh if int(cls[i]) not in seen], int)
                if len(seen) < 1_000_000:  # copies inside a task count once; only the order depends on it
                    seen.update(cls[fresh].tolist())
                for rows, band, _ in band_plan(n):
                    mine = np.isin(rows, fresh)
                    keys, _ = blocks(*_pick(sets, at, rows[mine]), band[mine])
                    np.add.at(cells, (keys >> _U(56 - CELL_BITS)).astype(np.int64), 1)
                bits = [sketch(sets[a:b], b - a) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(cls), pa.array(n.astype(np.int64)),
                     pa.array(bits, pa.binary()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.int64())],
                    ["doc_id", "cls", "n", "sketch", "cell", "hits"],
                )
        found = np.flatnonzero(cells > 4 + 2 * cells.mean())
        empty = [pa.nulls(len(found), pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.nulls(len(found), pa.binary()), pa.array(found, pa.int32()), pa.array(cells[found], pa.int64())],
            ["doc_id", "cls", "n", "sketch", "cell", "hits"],
        )

    schema = "doc_id long, cls long, n long, sketch binary, cell int, hits long"
    return storage.save(df.mapInArrow(run, schema), path)


def _levels(table: DataFrame) -> np.ndarray:
    """How common each cell is: 0, or 1 + log2 of its count over COMMON.  2**22 bytes."""
    hot = (
        table.where("cell is not null").groupBy("cell").agg(F.sum("hits").alias("hits"))
        .where(F.col("hits") >= COMMON).toPandas()  # at most one row a cell
    )
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    levels[hot["cell"].to_numpy(np.int64)] = 1 + np.log2(hot["hits"].to_numpy(float) / COMMON).astype(int) if len(hot) else 0
    return levels


def _packed_keys(df: DataFrame, levels: np.ndarray, buckets: int, split: int) -> DataFrame:
    """One row for each slice of documents and bucket: packed keys, positions and classes."""
    shared = df.sparkSession.sparkContext.broadcast(levels)
    split_level = 1 + max(0, int(np.log2(max(split / COMMON, 1))))

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        for batch in batches:
            for _, _, data, off in C.text_slices(batch.column(0)):
                sets, at = shingle_sets(data, off)
                cls = class_ids(sets, at)
                n = np.diff(at)
                _, fresh = np.unique(cls, return_index=True)  # one of each class
                sets, at = _pick(sets, at, fresh)
                cls, n = cls[fresh], n[fresh]
                keys, docs = [], []
                for rows, band, differ in band_plan(n):
                    found, begin = blocks(*_pick(sets, at, rows), band)
                    level = level_of[(found >> _U(56 - CELL_BITS)).astype(np.int64)].astype(_U)
                    ordered = found | (level << _U(56))
                    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                        ordered[lo:hi].sort()
                    count = np.diff(begin)
                    place = np.arange(len(ordered)) - np.repeat(begin[:-1], count)
                    first = place <= np.repeat(differ, count)
                    keys.append(ordered[first])
                    docs.append(np.repeat(rows, count)[first])
                key, doc = np.concatenate(keys), np.concatenate(docs)
                if not len(key):
                    continue
                body = key & _U((1 << 56) - 1)
                bucket = (((body >> _U(40)) * _U(buckets)) >> _U(16)).astype(np.int64)
                hot = (key >> _U(56)) >= _U(split_level)
                # Keys of very many classes: buckets of their own, dealt by slice.
                salt = np.where(hot, np.int64(int(cls[0]) % 251 + 1), 0)
                bucket = bucket * 256 + salt
                order = np.lexsort((body, bucket))
                bucket, body, doc = bucket[order], body[order], doc[order]
                at_bucket = np.flatnonzero(np.diff(bucket, prepend=-1))
                for lo, hi in zip(at_bucket.tolist(), [*at_bucket[1:].tolist(), len(bucket)], strict=True):
                    who, ref = np.unique(doc[lo:hi], return_inverse=True)
                    low = body[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bucket[lo])], pa.int64()), pa.array([low.tobytes()], pa.binary()),
                         pa.array([ref.astype("<u4").tobytes()], pa.binary()), pa.array([cls[who].tobytes()], pa.binary())],
                        ["bucket", "keys", "refs", "classes"],
                    )

    return df.select("text").mapInArrow(run, "bucket long, keys binary, refs binary, classes binary")


def _groups(packed: DataFrame) -> DataFrame:
    """gid, cls: classes that share a key.  Equal groups have equal ids."""

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        count = pc.divide(pc.binary_length(rows["keys"]), 6).to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(count)])
        body, cls = np.zeros(at[-1], "<u8"), np.zeros(at[-1], np.int64)
        for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            low = np.frombuffer(rows["keys"][i].as_buffer(), np.uint8).reshape(-1, 6)
            body[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6] = low
            who = np.frombuffer(rows["classes"][i].as_buffer(), np.int64)
            cls[lo:hi] = who[np.frombuffer(rows["refs"][i].as_buffer(), "<u4")]
        order = np.argsort(body)
        body = body[order]
        # Most keys are of one class; only the others are put in full order.
        same = np.zeros(len(body) + 1, bool)
        same[1:-1] = body[1:] == body[:-1]
        many = (same[1:] | same[:-1]) if key[0].as_py() % 256 == 0 else np.ones(len(body), bool)
        body, cls = body[many], cls[order[many]]
        order = np.lexsort((cls, body))
        body, cls = body[order], cls[order]
        new = np.ones(len(body), bool)
        new[1:] = (body[1:] != body[:-1]) | (cls[1:] != cls[:-1])
        body, cls = body[new], cls[new]
        begin = np.flatnonzero(np.diff(body, prepend=~body[:1]))
        size = np.diff(begin, append=len(body))
        if key[0].as_py() % 256 == 0:
            mark = np.add.reduceat(C.mix(cls.view(_U)), begin) if len(begin) else np.zeros(0, _U)
            gid = C.mix(mark + size.astype(_U))
            _, first = np.unique(gid, return_index=True)
            keep = np.zeros(len(gid), bool)
            keep[first] = True
            keep &= size > 1
        else:  # only a part of the key's classes is here: named by the key, put together later
            gid, keep = C.mix(body[begin]), np.ones(len(begin), bool)
        chosen = np.repeat(keep, size)
        return pa.table({"gid": pa.array(np.repeat(gid, size)[chosen].view(np.int64)), "cls": pa.array(cls[chosen])})

    return packed.groupBy("bucket").applyInArrow(gather, "gid long, cls long").distinct()


def sketch(hashes: np.ndarray, n: int) -> bytes:
    """Parity bits of a set, as many as the largest size of its band (64 at least)."""
    bits = max(64, 4 ** (int(bands_of(np.array([n]))[0]) + 1))
    odd = np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _payloads(df: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """cls, n and shingle hashes (packed) of the wanted documents."""

    @C.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in C.text_slices(batch.column(0)):
                sets, at = shingle_sets(data, off)
                cls, n = class_ids(sets, at), np.diff(at)
                parts = [sets[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls), pa.array(n.astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["cls", "n", "shingles"],
                )

    chosen = df.join(wanted, "doc_id", "left_semi").select("text")
    return storage.save(chosen.mapInArrow(run, "cls long, n long, shingles binary"), path)


def _near_sketches(n: np.ndarray, payload: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of the given members may be linked with one member: folded sketches within the bound."""
    width = min(len(p) for p in payload)
    rows = np.zeros((len(n), width // 8), _U)
    for i, p in enumerate(payload):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(p, "<u8").reshape(-1, width // 8), axis=0)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(rows[others] ^ rows[i]).sum(1)
        small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
        return (7 * apart.astype(np.int64) <= small + large) & (3 * large <= 4 * small)

    return near


def _near_sets(n: np.ndarray, payload: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of the given members are linked with one member: 100 * intersection >= 75 * union."""
    begin = np.concatenate([[0], np.cumsum(n)])
    _, token = np.unique(np.frombuffer(b"".join(payload), _U), return_inverse=True)
    mark = np.zeros(len(token) + 1, np.int32)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        mine = token[begin[i] : begin[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[token], begin[:-1])[others].astype(np.int64)
        mark[mine] = 0
        return 100 * common >= 75 * (n[others] + n[i] - common)

    return near


def _split_up(cls: np.ndarray, label: np.ndarray, near: Callable) -> list[tuple[int, int]]:
    """Edges that connect what links connect among the members; equal labels are connected already."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(cls))
    while len(left):
        group = left[label[left] == label[left[0]]]
        root = int(cls[left[0]])
        left = left[label[left] != label[left[0]]]
        front = group
        while len(front) and len(left):
            if len(front) <= len(left):
                hit = np.zeros(len(left), bool)
                for i in front.tolist():
                    open_ = np.flatnonzero(~hit)
                    if not len(open_):
                        break
                    hit[open_] = near(i, left[open_])
            else:
                hit = np.array([near(i, front).any() for i in left.tolist()])
            joined = left[hit]
            edges += [(root, int(c)) for c in cls[joined]]
            # With them come all that carry their labels.
            mates = np.isin(label[left], label[joined])
            front, left = left[mates], left[~mates]
    return edges


def resolve(groups: DataFrame, payloads: DataFrame, column: str, make: Callable, members: int = CHUNK_MEMBERS) -> DataFrame:
    """Edges (a, b) between classes such that inside every group exactly what pairwise nearness
    connects is connected.  groups: gid, cls.  Large groups are cut into chunks, see the module."""
    spark = groups.sparkSession
    sized = groups.join(payloads.select("cls", "n", F.octet_length(column).alias("_size")), "cls")
    totals = sized.groupBy("gid").agg(F.count(F.lit(1)).alias("g"), F.sum("_size").alias("_bytes"))
    totals = totals.where("g > 1").withColumn(
        "chunks", F.greatest(F.ceil(F.col("g") / members), F.ceil(F.col("_bytes") / CHUNK_BYTES)).cast("long")
    )
    placed = storage.save(
        sized.select("gid", "cls", "_size").join(totals.select("gid", "g", "chunks"), "gid"), storage.new_path(spark, "groups")
    )

    def local(rows: pa.Table) -> pa.Table:
        cls, label = rows["cls"].to_numpy(), rows["label"].to_numpy()
        near = make(rows["n"].to_numpy(), rows["payload"].to_pylist())
        edges = _split_up(cls, label, near)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    def compare(dealt: DataFrame) -> DataFrame:
        full = dealt.join(payloads.select("cls", "n", F.col(column).alias("payload")), "cls")
        return full.groupBy("gid", "chunk").applyInArrow(local, "a long, b long")

    own = F.pmod(F.xxhash64("cls", "gid"), F.col("chunks"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    shared = F.pmod(F.xxhash64(F.lit(3), "cls", "gid"), F.col("g")) < SHARED_MEMBERS
    dealt = placed.withColumn(
        "chunk", F.explode(F.when((F.col("chunks") > 1) & shared, everywhere).otherwise(F.array(own)))
    ).withColumn("label", F.col("cls"))
    edges = storage.save(compare(dealt).distinct(), storage.new_path(spark, "edges"))
    large = placed.where("chunks > 1")
    if large.isEmpty():
        return edges
    # What is not in a large group's largest component meets every chunk of the group, chunk by chunk.
    labels = components(edges)
    tagged = large.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "label", F.coalesce("label", "cls")
    )
    most = tagged.groupBy("gid", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("gid").agg(
        F.max(F.struct("k", "label"))["label"].alias("main")
    )
    tagged = storage.save(tagged.join(most, "gid"), storage.new_path(spark, "tagged"))
    apart = F.col("label") != F.col("main")
    rest = tagged.where(apart).groupBy("gid").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum("_size") / CHUNK_BYTES)).cast("long").alias("rests"))
    mine = F.pmod(F.xxhash64(F.lit(5), "cls", "gid"), F.col("rests"))
    every_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda r: r * F.col("chunks") + own)
    every_chunk = F.transform(everywhere, lambda c: mine * F.col("chunks") + c)
    again = tagged.join(rest, "gid").withColumn("chunk", F.explode(
        F.when(apart, F.array_union(every_rest, every_chunk)).otherwise(every_rest)))
    more = storage.save(compare(again).distinct(), storage.new_path(spark, "edges"))
    return edges.union(more)


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT,
                    members: int = CHUNK_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    Words are split at white space with A-Z lowered; shingles are five words, or the whole text if
    it has fewer; a null, empty or wordless text has none and links with nothing.  Equal sets share
    a class and a component.  component_id is the smallest id reachable by links of similarity 0.75
    or more.  Rows without an id link nothing and have no component; repeated rows are returned
    as often as they come.  An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.where("doc_id is not null")
    table = _fingerprints(docs, storage.new_path(spark, "fingerprints"))
    prints = table.where("cell is null").select("doc_id", "cls", "n")
    volume = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, round(0.4 * volume / KEYS_PER_BUCKET))
    groups = storage.save(
        _groups(_packed_keys(named, _levels(table), buckets, split)), storage.new_path(spark, "groups")
    )
    sets = prints.where("doc_id is not null and n > 0")
    classes = sets.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    sketches = table.where("n > 0 and doc_id is not null").select("cls", "n", "sketch")
    sketches = sketches.join(groups.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    sketches = storage.save(sketches, storage.new_path(spark, "sketches"))
    families = components(resolve(groups, sketches, "sketch", _near_sketches, members))
    # Only now the sets themselves, and only of classes that some sketch leaves as neighbours.
    wanted = classes.join(families.select(F.col("node").alias("cls")), "cls", "left_semi").select("doc_id")
    payloads = _payloads(named, wanted, storage.new_path(spark, "payloads")).dropDuplicates(["cls"])
    family_groups = families.select(F.col("label").alias("gid"), F.col("node").alias("cls"))
    linked = components(resolve(family_groups, payloads, "shingles", _near_sets, members))
    named_by = linked.join(classes, linked["node"] == classes["cls"]).groupBy("label").agg(
        F.min("doc_id").alias("component_id")
    )
    owner = linked.join(named_by, "label").select(F.col("node").alias("cls"), "component_id")
    smallest = classes.join(owner, "cls", "left").select(
        "cls", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    sets = sets.join(smallest, "cls", "left")
    rest = prints.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return sets.select("doc_id", "n", "cls", "component_id").union(
        rest.select("doc_id", "n", "cls", "component_id")
    ).select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), "component_id")
