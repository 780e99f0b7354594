"""Packing documents into training sequences by lexical retrieval.

A document's ids are those of its text plus the end-of-document id. Whole windows of
a long document are sequences of their own; what is left of every document (less
than a window) is packed. Document frequencies, document count and mean length are
those of all documents. Every document is scored by BM25 against the same
``LEADERS`` documents drawn from the whole table; its key is its best leaders, best
first, and leaders alike have numbers side by side. The documents in the order of
the key are cut into shards of about ``shard_tokens`` ids, so that copies and
documents of a topic meet wherever they lie in the table. A shard's task builds a
BM25 inverted index over its documents. A window starts with a seed document; the
index returns the shard's unused documents in falling BM25 score against the seed,
and they fill the window one after the other. Up to ``shard_tokens`` ids the search
covers every document; beyond that a neighbour whose key lies in another shard is
not seen. The document that meets the end
of the window is cut; its rest is the next seed. When a shard runs out, the ids of
its last window are cut into sequences of power-of-two lengths, so nothing is
padded.

Defined results: null and empty texts are the end-of-document id alone; repeated
rows and repeated ids are packed each for itself; a null doc_id stays null; an
empty table gives no rows; extra columns are not read. Every id lies in exactly one
piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.core import range_numbered

from .common import discard, small_batches, staged
from .registry import query, table
from .textbytes import tidy
from .word_tokens import tokenizer_for

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
OFTEN = 0.25  # part of a shard's documents that makes a term's weights a full row
KEPT = 0.8  # used documents leave a shard's index as soon as fewer are unused
SLICE_BYTES = 500_000
LEADERS, DEPTH = 256, 6  # a key holds DEPTH leader numbers of one byte


def id_type(size: int):
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def token_batches(vocabulary: str, end_id: int):
    """Ids of every text, some texts at a time: what a worker holds is bounded by
    ``SLICE_BYTES`` (or one longer text)."""

    def run(batches):
        tokenizer = tokenizer_for(vocabulary)
        kind = id_type(tokenizer.size)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
            ends, a = np.cumsum(size), 0
            while a < len(size):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + SLICE_BYTES, "right")))
                part = batch.slice(a, b - a)
                ids = tokenizer.encode([t or "" for t in part.column("text").to_pylist()])
                rows = [np.append(x, end_id).astype(kind).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "ids"])
                a = b

    return run


class CorpusStats:
    """BM25 statistics of all documents: idf by id, and the mean length."""

    def __init__(self, df: np.ndarray, n: int, total: int):
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.mean = total / n if n else 1.0


def changes(ordered: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    new = np.empty(len(ordered), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    cum = np.cumsum(count)
    return np.repeat(first - (cum - count), count) + np.arange(cum[-1] if len(cum) else 0)


def distinct(ids: np.ndarray) -> np.ndarray:
    """The distinct ids, sorted (faster than ``np.unique``; numpy sorts 32 bits faster than 16)."""
    s = np.sort(ids.astype(np.uint32))
    return s[changes(s)]


def rest_of(ids: np.ndarray, window: int) -> np.ndarray:
    """What whole windows leave of a document."""
    return ids[len(ids) // window * window:]


def survey(kind: str, size: int, window: int, leaders: int):
    """What one pass learns from a task's documents: partial sums (id, documents), (-1,
    documents), (-2, ids), and (-3, hash, rest) of the rests with the smallest hashes."""

    def run(batches):
        df, n, total, drawn = np.zeros(size, np.int64), 0, 0, {}
        border = 1 << 63
        for batch in batches:
            for x in batch.column("ids"):
                ids = rest_of(np.frombuffer(x.as_buffer(), kind), window)
                if len(ids):
                    df[distinct(ids)] += 1
                    n, total = n + 1, total + len(ids)
                    raw = ids.tobytes()
                    h = xxhash.xxh64_intdigest(raw) >> 1
                    if h < border:
                        drawn[h] = min(drawn.get(h, raw), raw)
                        if len(drawn) >= 2 * leaders:
                            drawn = dict(sorted(drawn.items())[:leaders])
                            border = max(drawn)
        terms = np.flatnonzero(df)
        first = sorted(drawn.items())[:leaders]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([terms, [-1, -2], np.full(len(first), -3)])),
             pa.array(np.concatenate([df[terms], [n, total], np.array([h for h, _ in first], np.int64)])),
             pa.array([None] * (len(terms) + 2) + [raw for _, raw in first], pa.binary())], names=["term", "n", "rest"])

    return run


def corpus_survey(tokens: DataFrame, kind: np.dtype, size: int, window: int) -> tuple[CorpusStats, list[np.ndarray]]:
    """Statistics of all documents, and the leaders: the rests with the smallest hashes,
    equal ones once. A row per id of the vocabulary and LEADERS rests of less than a
    window reach the driver."""
    found = staged(tokens.select("ids").mapInArrow(tidy(survey(kind.str, size, window, LEADERS)), "term long, n long, rest binary"), "survey")
    sums = dict(map(tuple, found.where("term > -3").groupBy("term").agg(F.sum("n")).collect()))
    n, total = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(size)
    df[list(sums)] = list(sums.values())
    drawn = found.where("term = -3").groupBy("n").agg(F.min("rest").alias("rest")).orderBy("n").limit(LEADERS).collect()
    return CorpusStats(df, n, total), [np.frombuffer(bytes(r["rest"]), kind) for r in drawn]


class ShardIndex:
    """BM25 inverted index over the ids of a shard's documents; without the
    statistics of all documents it takes those of its own."""

    def __init__(self, docs: list[np.ndarray], stats: CorpusStats | None = None):
        n = self.n = len(docs)
        sizes = np.array([len(d) for d in docs])
        terms = np.concatenate(docs)
        kind = np.uint32 if (int(terms.max(initial=0)) + 1) * n < 1 << 32 else np.int64
        pairs = terms.astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), sizes)
        pairs.sort()
        at = np.append(np.flatnonzero(changes(pairs)), len(pairs))
        pairs, tf = pairs[at[:-1]], np.diff(at)
        term = pairs // kind(n)
        self.doc = (pairs - term * kind(n)).astype(np.int64)
        self.first = np.append(np.flatnonzero(changes(term)), len(term))
        self.terms = term[self.first[:-1]].astype(np.int64)
        df = np.diff(self.first)
        idf = stats.idf[self.terms] if stats else np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / (stats.mean if stats else sizes.mean()))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self._hold(np.arange(n))

    def _hold(self, left: np.ndarray) -> None:
        """The documents the index holds; ``doc`` counts within them. Terms that a good
        part of them have get a row of weights over all of them."""
        self.left = left
        df = np.diff(self.first)
        often = np.flatnonzero(df >= np.maximum(OFTEN * len(left), 1))
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(left)))
        at = runs(self.first[often], df[often])
        self.rows[np.repeat(np.arange(len(often)), df[often]), self.doc[at]] = self.weight[at]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """BM25 of every document against the distinct terms of ``ids``."""
        t = np.searchsorted(self.terms, distinct(ids))
        row = self.row[t]
        often, t = row[row >= 0], t[row < 0]
        at = runs(self.first[t], self.first[t + 1] - self.first[t])
        score = self.rows.take(often, axis=0).sum(axis=0) + np.bincount(self.doc[at], self.weight[at], len(self.left))
        out = np.zeros(self.n)
        out[self.left] = score
        return out

    def keep(self, wanted: np.ndarray) -> None:
        """Forget all documents but the ``wanted`` ones: from now on they score 0."""
        wanted = wanted[self.left]
        held = wanted[self.doc]
        self.first = np.concatenate([[0], np.cumsum(held)])[self.first]
        self.doc, self.weight = (np.cumsum(wanted) - 1)[self.doc[held]], self.weight[held]
        self._hold(self.left[wanted])


class Leaders:
    """BM25 of any document against the leaders, as a table over their ids."""

    def __init__(self, docs: list[np.ndarray], stats: CorpusStats):
        index = ShardIndex(docs, stats)
        self.row = np.zeros(len(stats.idf), np.int32)  # row 0: ids of no leader
        self.row[index.terms] = np.arange(1, len(index.terms) + 1)
        self.table = np.zeros((len(index.terms) + 1, len(docs)), np.float32)
        self.table[np.repeat(np.arange(1, len(index.terms) + 1), np.diff(index.first)), index.doc] = index.weight
        # numbered along a chain, each followed by the free one most like it
        like, chain = np.stack([self.scores(d) for d in docs]), [0]
        like[:, 0] = -1
        while len(chain) < len(docs):
            chain.append(int(like[chain[-1]].argmax()))
            like[:, chain[-1]] = -1
        self.table = np.ascontiguousarray(self.table[:, chain])

    def scores(self, ids: np.ndarray) -> np.ndarray:
        return self.table.take(self.row[distinct(ids)], axis=0).sum(axis=0)

    def key(self, ids: np.ndarray) -> int:
        if not len(ids):
            return 0
        best = np.argsort(-self.scores(ids), kind="stable")[:DEPTH]
        return int.from_bytes(best.astype(np.uint8).tobytes().ljust(DEPTH, b"\0"), "big")


def keyed(kind: str, window: int, docs: list[np.ndarray], stats: CorpusStats):
    """Every row with its key."""

    def run(batches):
        leaders = Leaders(docs, stats) if docs else None  # none if the documents are whole windows only
        for batch in batches:
            key = [leaders.key(rest_of(np.frombuffer(x.as_buffer(), kind), window)) if leaders else 0 for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], names=[*batch.schema.names, "key"])

    return run


def dealt(bounds: list[tuple[int, int]]):
    """Every row with its shard, from the shards' first (key, rid)."""

    def run(batches):
        for batch in batches:
            at = zip(batch.column("key").to_pylist(), batch.column("rid").to_pylist())
            shard = [max(bisect_right(bounds, x) - 1, 0) for x in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], names=[*batch.schema.names, "shard"])

    return run


def shard_starts(before: dict[int, int], per_shard: int):
    """The first row of every shard, and of every range of the ordered rows."""

    def run(batches):
        at, last = None, None
        for batch in batches:
            out = []
            for pid, key, rid, n in zip(*(batch.column(c).to_pylist() for c in ("__pid", "key", "rid", "n"))):
                at = before[pid] if at is None else at
                if at // per_shard != last:
                    last = at // per_shard
                    out.append((last, key, rid))
                at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["shard", "key", "rid"])

    return run


def shard_bounds(small: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """First (key, rid) of every shard: the rows in order, cut by their running ids.
    The driver sees one row per range and one per shard and range."""
    ordered = range_numbered(small, ["key", "rid"]).select("__pid", "key", "rid", "n")
    before, at = {}, 0
    for r in sorted(ordered.groupBy("__pid").agg(F.sum("n").alias("n")).collect()):
        before[r["__pid"]], at = at, at + r["n"]
    starts: dict[int, tuple[int, int]] = {}
    for r in ordered.mapInArrow(shard_starts(before, -(-total // shards)), "shard long, key long, rid long").collect():
        starts[r["shard"]] = min(starts.get(r["shard"], (r["key"], r["rid"])), (r["key"], r["rid"]))
    return sorted(starts.values())


def fill_windows(docs: list[np.ndarray], window: int, stats: CorpusStats | None = None):
    """Yield (document, start, length, sequence, offset) over a shard's documents."""
    index = ShardIndex(docs, stats)
    unused = np.ones(len(docs), bool)
    lowest, sequence, carried = 0, 0, None
    while True:
        if carried is None:
            while lowest < len(docs) and not unused[lowest]:
                lowest += 1
            if lowest == len(docs):
                return
            carried = (lowest, 0)
            unused[lowest] = False
        filled, pieces = 0, []
        seed, start = carried
        carried = None
        ranked = None
        doc = seed
        while doc is not None:
            size = min(len(docs[doc]) - start, window - filled)
            pieces.append((doc, start, size, filled))
            filled += size
            if start + size < len(docs[doc]):
                carried = (doc, start + size)
            if filled == window:
                break
            if ranked is None:
                if unused.sum() < KEPT * len(index.left):
                    index.keep(unused)
                score = np.where(unused, index.scores(docs[seed]), -1.0)
                # the best few first; the rest only if they do not fill the window
                some = np.argpartition(-score, min(32, len(score) - 1))[:33]
                some = some[np.argsort(-score[some], kind="stable")]
                ranked, whole = iter(some[score[some] >= 0].tolist()), False
            doc, start = next(ranked, None), 0
            if doc is None and not whole:
                order = np.argsort(-np.where(unused, score, -1.0), kind="stable")
                ranked, whole = iter(order[unused[order]].tolist()), True
                doc = next(ranked, None)
            if doc is not None:
                unused[doc] = False
        if filled == window:
            yield from ((d, s, n, sequence, o) for d, s, n, o in pieces)
            sequence += 1
            continue
        # the shard's last window: sequences of power-of-two lengths, longest first
        room, offset = 0, 0
        for d, s, n, _ in pieces:
            while n:
                if not room:
                    room, offset = 1 << (filled.bit_length() - 1), 0
                    filled -= room
                    sequence += 1
                take = min(n, room)
                yield d, s, take, sequence - 1, offset
                s, n, room, offset = s + take, n - take, room - take, offset + take


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_shard(window: int, kind: str, with_ids: bool, stats: CorpusStats):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        docs = [np.frombuffer(x, kind) for x in pdf["ids"]]
        names = [None if none else int(i) for i, none in zip(pdf["doc_id"], pdf["no_id"])]
        whole = [len(d) // window * window for d in docs]
        rows, sequence = [], 0

        def add(doc, start, size, seq, offset):
            ids = docs[doc][start:start + size].astype("<u4").tobytes()
            rows.append((names[doc], start, size, zlib.crc32(ids), len(docs[doc]), (int(key[0]) << 40) + seq, offset,
                         ids if with_ids else None))

        for doc, size in enumerate(whole):
            for start in range(0, size, window):
                add(doc, start, window, sequence, 0)
                sequence += 1
        left = [i for i, d in enumerate(docs) if whole[i] < len(d)]
        for doc, start, size, seq, offset in fill_windows([docs[i][whole[i]:] for i in left], window, stats) if left else ():
            add(left[doc], whole[left[doc]] + start, size, sequence + seq, offset)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
        out["doc_id"] = pd.array([r[0] for r in rows], "Int64")  # a null must not turn ids into floats
        return out

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, window: int = WINDOW,
         shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, on request, the ids (little-endian unsigned 32-bit)."""
    size = tokenizer_for(vocabulary).size
    kind = id_type(size)
    size = max(size, end_id + 1)
    with small_batches(docs.sparkSession):
        tokens = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(token_batches(vocabulary, end_id)), "doc_id long, ids binary")
        tokens = staged(tokens.withColumn("rid", F.monotonically_increasing_id()), "token_ids")
    total = (tokens.agg(F.sum(F.length("ids"))).first()[0] or 0) // kind.itemsize
    shards = max(1, -(-total // shard_tokens))
    stats, leaders = corpus_survey(tokens, kind, size, window)
    rows = tokens.withColumn("shard", F.lit(0).cast("long"))
    if shards > 1:
        types = "doc_id long, ids binary, rid long, key long"
        with_key = staged(tokens.mapInArrow(tidy(keyed(kind.str, window, leaders, stats)), types), "keyed_ids")
        discard(tokens)
        small = with_key.select("rid", "key", F.floor(F.length("ids") / kind.itemsize).alias("n"))
        rows = with_key.mapInArrow(dealt(shard_bounds(small, total, shards)), types + ", shard long")
    rows = rows.select("rid", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "ids", "shard")
    out = rows.groupBy("shard").applyInPandas(pack_shard(window, kind.str, with_ids, stats), PIECES)
    return out if with_ids else out.drop("ids")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed sequences' pieces with their ids."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


@query("op6_lexical_packing")
def op6_lexical_packing(spark, d):
    return pack(table(spark, d, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)
