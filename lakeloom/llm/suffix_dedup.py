"""Removing repeated byte strings: suffixes of all documents, sorted to a bounded depth.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier
(a smaller doc_id, or the same document further left); strings are judged on the input.
Only the equality of strings of that length matters, so suffixes are sorted to that
depth and no further, by bucket-pointer refinement (``bucket_refine``).

How the buckets are dealt over tasks: a string's anchor is that of its q-grams
(q = length - WINDOW + 1) with the smallest hash, the leftmost of equals. Equal strings
have equal anchors at the same place, so all positions of a bucket meet where their
anchor gram is sent. Neighbouring strings mostly share an anchor: the run of them is
one context, and contexts are what moves.

1. Blocks (following documents of a file) send their distinct anchor hashes, with a hash
   of the context; those found once in the whole table are dropped (most of them), the
   others return to their blocks.
2. Blocks cut the contexts of repeated anchors. A context that its block holds already
   is removed on the spot; the first one is sent to its anchor's pack. Where an anchor
   has one context in the whole table (whole copies: both hashes agree, 128 bits), only
   the place is sent, and all but the earliest place are removed.
3. A pack removes contexts that are the same, and sorts the positions of the rest by
   bucket-pointer refinement; of equal strings all but the earliest are removed.
4. An anchor with more than ``HOT`` contexts is not gathered: each of its strings goes
   by its own 128-bit hash, a block sending each at most once.
5. Documents meet their removed ranges and are cut.

Packs and blocks are sized by the bytes of the whole table, so their number grows with
it; a text longer than a slice is cut into slices that overlap by a string.

Defined results: null and empty texts have no bytes and stay; a null doc_id sorts after
all others; of rows sharing a doc_id the one read first is earlier, and each has its own
result row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_refine import equal_buckets, gram_hashes_at_all, prefix_sums, range_hashes, runs
from .common import discard, staged
from .registry import query, table
from .textbytes import SLICE_BYTES, mix64, text_slices

LENGTH = 100
WINDOW = 64  # q-grams in a string among which the anchor is chosen: a power of two
BLOCK_BYTES = 4_000_000
PACK_BYTES = 16_000_000
HOT = 4_096
CHUNK_BYTES = 2_000_000
_U = np.uint64

ANCHOR = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("distinct", "<u2"), ("again", "u1")])
PLACE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<i8"), ("size", "<i8")])  # where a range starts, and its bytes
CONTEXT = np.dtype([("gram", "<u8"), *PLACE.descr])
STRING = np.dtype([("h1", "<u8"), ("h2", "<u8"), *PLACE.descr])
RANGE = np.dtype([("row", "<i8"), ("at", "<i8"), ("size", "<i8")])


def contexts(offsets: np.ndarray, data: np.ndarray, length: int):
    """(first, last, gram hash, prefix sums): runs of string starts that share an anchor."""
    q = length - WINDOW + 1
    sums = prefix_sums(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, _U), sums
    grams = gram_hashes_at_all(sums, q)
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)  # equals: the leftmost
    step = 1
    while step < WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    sizes = np.diff(offsets)
    edge = np.zeros(len(data) + 1, np.int32)  # starts whose string would leave the document
    np.add.at(edge, offsets[1:] - np.minimum(sizes, length - 1), 1)
    np.add.at(edge, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(edge[:len(low)]) == 0)
    if not len(start):
        return none, none, np.zeros(0, _U), sums
    anchor = (low[start] & _U(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    head, tail = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    return start[head], start[tail], grams[anchor[head]], sums


def pieces(bodies: pa.Array, length: int):
    """Yield (rows, base, offsets, bytes): slices of whole texts, or of one long text at ``base``."""
    for row, off, data in text_slices(bodies):
        if len(off) == 2 and len(data) > SLICE_BYTES:
            for base in range(0, len(data) - length + 1, SLICE_BYTES):
                part = data[base:base + SLICE_BYTES + length - 1]
                yield np.array([row]), base, np.array([0, len(part)]), part
        else:
            yield np.arange(row, row + len(off) - 1), 0, off, data


def as_strings(column) -> pa.Array:
    """A binary column as text_slices reads it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.view(pa.large_string() if pa.types.is_large_binary(column.type) else pa.string())


def by_pack(pack: np.ndarray):
    """(pack, indices) of each pack."""
    order = np.argsort(pack, kind="stable")
    cut = runs(pack[order])
    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            yield int(pack[order[a]]), order[a:b]


def number_blocks(size: int):
    """Following rows of a task in blocks of about ``size`` bytes."""

    def run(batches):
        block, held = 0, 0
        for batch in batches:
            out = []
            for row, n in zip(batch.column("row").to_pylist(), pc.binary_length(batch.column("body")).to_pylist()):
                if held and held + n > size:
                    block, held = block + 1, 0
                held += n
                out.append((row >> 33 << 32) + block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "block"])

    return run


def send_anchors(length: int, packs: int):
    """(pack, block, anchors) of each run of a block's rows: each anchor hash once, whether
    it is seen again, with how many different contexts, and the smallest context hash."""

    def send(block: int, found: list) -> pa.Table:
        pairs = np.stack([np.concatenate(x) if x else np.zeros(0, _U) for x in list(zip(*found)) or ((), ())], axis=1)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        gram, whole = pairs[order, 0], pairs[order, 1]
        cut = runs(gram)
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])])[:len(gram)]
        out = np.zeros(len(cut) - 1 if len(gram) else 0, ANCHOR)
        if len(out):
            out["gram"], out["whole"], out["again"] = gram[cut[:-1]], whole[cut[:-1]], np.diff(cut) > 1
            out["distinct"] = np.minimum(np.add.reduceat(new.astype(np.int64), cut[:-1]), 0xFFFF)
        return table_of([(pack, block, out[i].tobytes()) for pack, i in by_pack((out["gram"] % _U(packs)).astype(np.int64))], ANCHORS)

    def run(batches):
        now, found = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cut = runs(blocks)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if blocks[a] != now:
                    yield from send(now, found).to_batches()
                    now, found = int(blocks[a]), []
                for _, _, off, data in pieces(as_strings(batch.column("body").slice(a, b - a)), length):
                    first, last, gram, sums = contexts(off, data, length)
                    found.append((gram, range_hashes(sums, first, last + length)))
        yield from send(now, found).to_batches()

    return run


ANCHORS = [("pack", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary())]
REPEATED = [("block", pa.int64()), ("anchors", pa.binary()), ("way", pa.binary())]
SENT = [("pack", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("places", pa.binary()), ("bytes", pa.binary())]
REMOVED = [("block", pa.int64()), ("ranges", pa.binary())]
CUT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.list_(pa.int64())))]
WHOLE, STRINGS, GONE, PLACES = range(4)  # kinds of what a block sends
COLD, MANY, ONE = range(3)  # an anchor's way: by its contexts, by single strings, by places alone


def table_of(rows: list, spec: list) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in spec]
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, spec)], names=[n for n, _ in spec])


def ddl(spec: list) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{n} {kinds.get(t, 'array<array<long>>')}" for n, t in spec)


def arrays(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def repeated_anchors(hot: int):
    """The anchors seen more than once, back to each block that holds them."""

    def run(given: pa.Table) -> pa.Table:
        parts = arrays(given.column("anchors"), ANCHOR)
        found = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(found["gram"], kind="stable")
        cut = runs(found["gram"][order])
        if len(cut) < 2:
            return table_of([], REPEATED)
        size, head = np.diff(cut), cut[:-1]
        distinct, whole = found["distinct"][order].astype(np.int64), found["whole"][order]
        again = np.repeat((size > 1) | (np.maximum.reduceat(found["again"][order], head) > 0), size)
        one = (np.maximum.reduceat(distinct, head) == 1) & (np.minimum.reduceat(whole, head) == np.maximum.reduceat(whole, head))
        way = np.repeat(np.where(one, ONE, np.where(np.add.reduceat(distinct, head) > hot, MANY, COLD)), size)
        order, way = order[again], way[again].astype(np.uint8)
        blocks = given.column("block").to_pylist()
        rows = [(blocks[p], found["gram"][order[i]].tobytes(), way[i].tobytes()) for p, i in by_pack(owner[order])]
        return table_of(rows, REPEATED)

    return run


def same_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at a[i] and b[i] are the same over size[i] (1 at least)."""
    out = np.ones(len(a), bool)
    step = max(1, 4_000_000 // int(size.max())) if len(a) else 1
    for i in range(0, len(a), step):
        n = size[i:i + step]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        same = data[np.repeat(a[i:i + step], n) + inside] == data[np.repeat(b[i:i + step], n) + inside]
        out[i:i + step] = np.logical_and.reduceat(same, first)
    return out


def repeats(keys: tuple, data: np.ndarray, at: np.ndarray, size: np.ndarray):
    """(index, index of the first with the same keys and bytes) of every later one, in the order of the last key."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in (*keys[:-1], size):
        v = k[order]
        new[1:] |= v[1:] != v[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.flatnonzero(head != np.arange(len(order)))
    i, first = order[later], order[head[later]]
    same = same_ranges(data, at[i], at[first], size[i])
    return i[same], first[same]


def send_contexts(length: int, packs: int, string_packs: int):
    """What a block sends: contexts of repeated anchors to the anchors' packs, single strings
    of hot anchors to the strings' packs, and the ranges it removes itself."""

    def run(docs: pa.Table, sets: pa.Table) -> pa.Table:
        if not len(sets) or not len(docs):
            return table_of([], SENT)
        block = docs.column("block")[0].as_py()
        wanted = np.concatenate(arrays(sets.column("anchors"), "<u8"))
        way = np.concatenate(arrays(sets.column("way"), np.uint8))
        order = np.argsort(wanted)
        wanted, way = wanted[order], way[order]
        doc = docs.column("doc").to_numpy()
        rows = docs.column("row").to_numpy()
        order = np.lexsort((rows, doc))  # the block's first one is the earliest
        doc, rows = doc[order], rows[order]
        bodies = as_strings(docs.column("body").take(pa.array(order)))
        gathered: list = []
        for which, base, off, data in pieces(bodies, length):
            first, last, gram, sums = contexts(off, data, length)
            place = np.searchsorted(wanted, gram)
            place[place == len(wanted)] = 0
            keep = wanted[place] == gram
            first, last, gram, place = first[keep], last[keep], gram[keep], place[keep]
            owner = which[np.searchsorted(off, first, "right") - 1]
            meta = np.zeros(len(first), CONTEXT)
            meta["gram"], meta["doc"], meta["row"] = gram, doc[owner], rows[owner]
            meta["at"] = first - off[np.searchsorted(off, first, "right") - 1] + base
            meta["size"] = last + length - first
            n = meta["size"]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gathered.append((meta, range_hashes(sums, first, last + length), way[place], data[np.repeat(first, n) + inside]))
        if not gathered:
            return table_of([], SENT)
        meta, whole, way, text = (np.concatenate(x) for x in zip(*gathered))
        n = meta["size"]
        at = np.cumsum(n) - n
        later, _ = repeats((meta["gram"], whole, np.arange(len(meta))), text, at, n)
        out = [(block, block, GONE, meta[later][["row", "at", "size"]].astype(RANGE).tobytes(), None)] if len(later) else []
        left = np.ones(len(meta), bool)
        left[later] = False
        for kind, which in ((WHOLE, COLD), (PLACES, ONE)):
            for pack, i in by_pack(np.where(left & (way == which), (meta["gram"] % _U(packs)).astype(np.int64), -1)):
                if pack >= 0:
                    out.append((pack, block, kind, meta[i].tobytes(), take_ranges(text, at[i], n[i]).tobytes() if kind == WHOLE else None))
        i = np.flatnonzero(left & (way == MANY))
        if len(i):
            out += send_strings(meta[i], take_ranges(text, at[i], n[i]), length, string_packs, block)
        return table_of(out, SENT)

    return run


def take_ranges(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return data[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def starts_of(size: np.ndarray, length: int):
    """(context, start in the joined text) of every string of the contexts."""
    n = size - length + 1
    owner = np.repeat(np.arange(len(size)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return owner, np.repeat(np.cumsum(size) - size, n) + inside, inside


def send_strings(meta: np.ndarray, text: np.ndarray, length: int, packs: int, block: int) -> list:
    owner, start, inside = starts_of(meta["size"], length)
    found = np.zeros(len(start), STRING)
    found["h1"] = range_hashes(prefix_sums(text), start, start + length)
    found["h2"] = range_hashes(prefix_sums(_OTHER[text]), start, start + length)
    for c in ("doc", "row"):
        found[c] = meta[c][owner]
    found["at"], found["size"] = meta["at"][owner] + inside, length
    order = np.lexsort((found["at"], found["row"], found["doc"], found["h2"], found["h1"]))
    found = found[order]
    later = np.zeros(len(found), bool)
    later[1:] = (found["h1"][1:] == found["h1"][:-1]) & (found["h2"][1:] == found["h2"][:-1])
    out = [(block, block, GONE, found[later][["row", "at", "size"]].astype(RANGE).tobytes(), None)] if later.any() else []
    found = found[~later]
    for pack, i in by_pack((found["h1"] % _U(packs)).astype(np.int64)):
        out.append((pack, block, STRINGS, found[i].tobytes(), None))
    return out


_OTHER = np.argsort(mix64(np.arange(256, dtype=_U))).astype(np.uint8)  # a permutation of the bytes: a second hash


def by_block(blocks: np.ndarray, found: np.ndarray) -> pa.Table:
    return table_of([(b, found[i].tobytes()) for b, i in by_pack(blocks)], REMOVED)


def merged(row: np.ndarray, at: np.ndarray, length: int, extra: np.ndarray):
    """Ranges of runs of following starts: (ranges, extra of each)."""
    order = np.lexsort((at, row))
    row, at, extra = row[order], at[order], extra[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1 if len(head) else head
    out = np.zeros(len(head), RANGE)
    out["row"], out["at"], out["size"] = row[head], at[head], at[tail] - at[head] + length
    return out, extra[head]


def later_strings(length: int):
    """A strings' pack: of equal hashes all but the earliest are removed."""

    def run(given: pa.Table) -> pa.Table:
        parts = arrays(given.column("places"), STRING)
        found = np.concatenate(parts)
        blocks = np.repeat(given.column("block").to_numpy(), [len(p) for p in parts])
        order = np.lexsort((found["at"], found["row"], found["doc"], found["h2"], found["h1"]))
        found, blocks = found[order], blocks[order]
        later = np.zeros(len(found), bool)
        later[1:] = (found["h1"][1:] == found["h1"][:-1]) & (found["h2"][1:] == found["h2"][:-1])
        ranges, owner = merged(found["row"][later], found["at"][later], length, blocks[later])
        return by_block(owner, ranges)

    return run


def later_places(given: pa.Table) -> pa.Table:
    """Anchors with one context in the whole table: all places but the earliest are removed."""
    parts = arrays(given.column("places"), CONTEXT)
    found = np.concatenate(parts)
    blocks = np.repeat(given.column("block").to_numpy(), [len(p) for p in parts])
    order = np.lexsort((found["at"], found["row"], found["doc"], found["gram"]))
    found, blocks = found[order], blocks[order]
    later = np.zeros(len(found), bool)
    later[1:] = found["gram"][1:] == found["gram"][:-1]
    return by_block(blocks[later], found[later][["row", "at", "size"]].astype(RANGE))


def later_contexts(length: int):
    """An anchors' pack: bucket-pointer refinement over whole anchors, some at a time."""

    def run(given: pa.Table) -> pa.Table:
        parts = arrays(given.column("places"), CONTEXT)
        meta = np.concatenate(parts)
        blocks = np.repeat(given.column("block").to_numpy(), [len(p) for p in parts])
        text = np.concatenate(arrays(given.column("bytes"), np.uint8))
        at = np.cumsum(meta["size"]) - meta["size"]
        order = np.lexsort((meta["at"], meta["row"], meta["doc"], meta["gram"]))
        cut = runs(meta["gram"][order])
        total = np.concatenate([[0], np.cumsum(meta["size"][order])])
        out, owners, a = [], [], 0
        while a < len(cut) - 1:
            b = max(a + 1, int(np.searchsorted(total[cut], total[cut[a]] + CHUNK_BYTES, "right")) - 1)
            i = order[cut[a]:cut[b]]
            for ranges, owner in refine_chunk(meta[i], take_ranges(text, at[i], meta["size"][i]), length, blocks[i]):
                out.append(ranges)
                owners.append(owner)
            a = b
        return by_block(np.concatenate(owners), np.concatenate(out)) if out else table_of([], REMOVED)

    return run


def refine_chunk(meta: np.ndarray, text: np.ndarray, length: int, blocks: np.ndarray):
    """Yield (ranges, blocks) removed among contexts sorted by anchor, then place."""
    n = meta["size"]
    at = np.cumsum(n) - n
    sums = prefix_sums(text)
    later, _ = repeats((meta["gram"], range_hashes(sums, at, at + n), np.arange(len(meta))), text, at, n)
    yield meta[later][["row", "at", "size"]].astype(RANGE), blocks[later]
    left = np.ones(len(meta), bool)
    left[later] = False
    kept = np.flatnonzero(left)
    kept = kept[np.isin(meta["gram"][kept], repeated_values(meta["gram"][kept]))]
    if not len(kept):
        return
    text, meta, blocks = take_ranges(text, at[kept], n[kept]), meta[kept], blocks[kept]
    owner, start, inside = starts_of(meta["size"], length)
    members, bucket = equal_buckets(text, start, length)
    i = np.searchsorted(start, members)
    owner, inside = owner[i], inside[i]
    doc, row, place = meta["doc"][owner], meta["row"][owner], meta["at"][owner] + inside
    order = np.lexsort((place, row, doc, bucket))
    later = np.zeros(len(order), bool)
    later[1:] = bucket[order][1:] == bucket[order][:-1]
    j = order[later]
    yield merged(row[j], place[j], length, blocks[owner[j]])


def repeated_values(sorted_values: np.ndarray) -> np.ndarray:
    cut = runs(sorted_values)
    return sorted_values[cut[:-1]][np.diff(cut) > 1] if len(sorted_values) else sorted_values


def cut_documents(docs: pa.Table, removed: pa.Table) -> pa.Table:
    """A block's documents without their removed ranges."""
    if not len(docs):
        return table_of([], CUT)
    parts = arrays(removed.column("ranges"), RANGE) if len(removed) else []
    gone = np.concatenate(parts) if parts else np.zeros(0, RANGE)
    gone = gone[np.argsort(gone["row"], kind="stable")]
    rows = []
    for doc_id, row, body in zip(docs.column("doc_id").to_pylist(), docs.column("row").to_pylist(), docs.column("body")):
        data = np.frombuffer(body.as_buffer(), np.uint8) if body.is_valid else np.zeros(0, np.uint8)
        a, b = np.searchsorted(gone["row"], [row, row + 1])
        if a == b:
            rows.append((doc_id, len(data), data.tobytes(), []))
            continue
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, gone["at"][a:b], 1)
        np.add.at(edge, gone["at"][a:b] + gone["size"][a:b], -1)
        covered = np.cumsum(edge[:-1]) > 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        rows.append((doc_id, len(data), data[~covered].tobytes(), change.reshape(-1, 2).tolist()))
    return table_of(rows, CUT)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, kept, removed): the bytes that stay, and the removed runs as
    [start, end] pairs of byte offsets."""
    if length % 4 or length < WINDOW + 8:
        raise ValueError(f"length must be divisible by four and at least {WINDOW + 8}")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")) \
        .withColumn("row", F.monotonically_increasing_id())
    given = staged(given.mapInArrow(number_blocks(BLOCK_BYTES), "doc_id long, body binary, row long, block long"), "bodies")
    total = given.agg(F.sum(F.length("body"))).first()[0] or 0
    string_packs, packs = -(-total // BLOCK_BYTES) or 1, -(-total // PACK_BYTES) or 1
    given = given.withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))

    sent = given.select("block", "body").mapInArrow(send_anchors(length, packs), ddl(ANCHORS))
    sets = staged(sent.groupBy("pack").applyInArrow(repeated_anchors(hot), ddl(REPEATED)), "repeated_anchors")
    out = given.select("block", "doc", "row", "body").groupBy("block").cogroup(sets.groupBy("block")) \
        .applyInArrow(send_contexts(length, packs, string_packs), ddl(SENT))
    out = staged(out, "contexts", partition_by="kind")
    discard(sets)
    whole = out.where(F.col("kind") == WHOLE).drop("kind").groupBy("pack").applyInArrow(later_contexts(length), ddl(REMOVED))
    strings = out.where(F.col("kind") == STRINGS).drop("kind").groupBy("pack").applyInArrow(later_strings(length), ddl(REMOVED))
    places = out.where(F.col("kind") == PLACES).drop("kind", "bytes").groupBy("pack").applyInArrow(later_places, ddl(REMOVED))
    gone = out.where(F.col("kind") == GONE).select("block", F.col("places").alias("ranges"))
    removed = staged(gone.unionByName(whole).unionByName(places).unionByName(strings), "removed")
    discard(out)
    return given.select("block", "doc_id", "row", "body").groupBy("block").cogroup(removed.groupBy("block")) \
        .applyInArrow(cut_documents, ddl(CUT))


def reference_cut(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The definition, on (doc_id, text) rows: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        body = (docs[i][1] or "").encode()
        covered = bytearray(len(body) + 1)
        for s in range(len(body) - length + 1):
            part = body[s:s + length]
            if part in seen:
                covered[s:s + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, c in zip(body, covered) if not c)
        n_spans = sum(1 for j in range(len(body)) if covered[j] and not (j and covered[j - 1]))
        out.append((docs[i][0], len(body), len(body) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


SQL = """
WITH d AS (SELECT doc_id, strlen(COALESCE(text, '')) AS n, hex(encode(COALESCE(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, c, substr(x, 2 * c + 1, 598) AS y FROM (SELECT doc_id, x, unnest(range(0, n, 200)) AS c FROM d)),
p AS (SELECT doc_id, c + o AS s, substr(y, 2 * o + 1, 200) AS g FROM (SELECT *, unnest(range(least(200, strlen(y) // 2 - 99))) AS o FROM c)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM p),
e AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS first
      FROM f WHERE k > 1),
i AS (SELECT doc_id, s, SUM(first) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e),
r AS (SELECT doc_id, MIN(s) AS a, MAX(s) + 100 AS b FROM i GROUP BY doc_id, run),
g AS (SELECT d.doc_id, n, a, b, x, COALESCE(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS z,
             lead(a) OVER (PARTITION BY d.doc_id ORDER BY a) IS NULL AS last
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, ANY_VALUE(n) AS n_bytes, CAST(COALESCE(SUM(b - a), 0) AS BIGINT) AS n_removed, COUNT(a) AS n_spans,
       sha256(unhex(string_agg(CASE WHEN a IS NULL THEN x ELSE substr(x, 2 * z + 1, 2 * (a - z))
                                    || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END END, '' ORDER BY a))) AS kept_sha256
FROM g GROUP BY doc_id
"""


@query("op11_suffix_array_dedup", SQL)
def op11_suffix_array_dedup(spark, d):
    out = dedup_substrings(table(spark, d, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
