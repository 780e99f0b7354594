"""N-gram Jaccard self-join by MinHash banding.

Two documents link if the Jaccard similarity of their sets of ``k``-word
shingles is at least ``threshold``. Words are maximal runs without white space
(space, \\t, \\n, \\v, \\f, \\r) with A-Z lower-cased; a text of fewer than k words
has one shingle, all of its words.

1. One pass hashes words and shingles and gives each document a 128-bit hash of
   its word sequence and its MinHash bands. The band and row counts are chosen so
   that a pair at the threshold shares a band with probability
   ``target_recall``, with the most rows that ``max_hashes`` allows.
2. Documents of one word sequence form a class (similarity 1, never paired).
3. Classes are shuffled on (band, band hash). Buckets with the same members are
   taken once. Buckets are cut into chunks of ``CHUNK`` members, and every pair
   of chunks is verified in one task on the full shingle sets. A pair is counted
   only in the first bucket that holds both classes, so no pair is emitted: a
   task returns each member's links and a label that connects linked members.
4. Connected components over those labels.

Defined results: null and empty texts have no shingles, are alike, and form one
class; null ids never become a class id while another id is in the class; rows
sharing an id are separate documents; an empty table gives no rows; extra columns
are kept by ``one_per_group`` and not read otherwise. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, staged
from .registry import query, table
from .textbytes import LOWER, NON_SPACE, gram_hashes, mix64, spans, text_slices, tidy, word_hashes, words

CHUNK = 256
_U = np.uint64


def choose_bands(threshold: float, target_recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - target_recall) / math.log(1 - threshold ** rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {max_hashes} hashes reaches recall {target_recall} at {threshold}")
    return best


def shingles(offsets, data, k):
    """(word hashes, first word, shingle hashes, first shingle) of a slice."""
    low = LOWER[data]
    starts, ends, first = words(offsets, low, NON_SPACE)
    h = word_hashes(low, starts, ends)
    g, gram_first, _ = gram_hashes(h, first, k)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.empty(len(short), _U)
        for i, d in enumerate(short):
            x = _U(count[d])
            for w in h[first[d]:first[d + 1]]:
                x = mix64(np.array([x ^ w], _U))[0]
            own[i] = x
        g = np.insert(g, gram_first[short], own)
        extra = np.zeros(len(count), np.int64)
        extra[short] = 1
        gram_first = gram_first + np.concatenate([[0], np.cumsum(extra)])
    return h, first, g, gram_first


def sequence_hashes(h, first) -> np.ndarray:
    """A 128-bit hash of each text's words in their order (0, 0 for no words)."""
    out = np.zeros((len(first) - 1, 2), _U)
    some, at = spans(first)
    if len(some):
        place = np.arange(len(h), dtype=_U) - np.repeat(first[:-1], np.diff(first)).astype(_U)
        for j, salt in enumerate((_U(0x51), _U(0xA7))):
            out[some, j] = np.add.reduceat(mix64(h ^ mix64(place + (salt << _U(40)))), at)
    return out


def signature_batches(k: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * _U(2) + _U(1)

    def run(batches):
        for batch in batches:
            n = len(batch)
            sig, band = np.zeros((n, 2), _U), np.zeros((n, bands), _U)
            for row, off, data in text_slices(batch.column("text")):
                h, first, g, gram_first = shingles(off, data, k)
                sig[row:row + len(off) - 1] = sequence_hashes(h, first)
                some, at = spans(gram_first)
                for b in range(bands if len(some) else 0):
                    acc = np.zeros(len(some), _U)
                    for r in range(rows):
                        low = np.minimum.reduceat((g * odd[b * rows + r]) >> _U(24), at)
                        acc = mix64(acc * _U(31) + low)
                    band[row + some, b] = acc
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sig[:, 0].view(np.int64)), pa.array(sig[:, 1].view(np.int64)),
                 pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), band.reshape(-1).view(np.int64))],
                names=["id", "c1", "c2", "bands"])

    return run


def set_batches(k: int):
    def run(batches):
        for batch in batches:
            sets, sig = [], []
            for _, off, data in text_slices(batch.column("text")):
                h, first, g, gram_first = shingles(off, data, k)
                sig.append(sequence_hashes(h, first))
                sets += [np.unique(g[a:b]).tobytes() for a, b in zip(gram_first[:-1], gram_first[1:])]
            if sets:
                sig = np.concatenate(sig).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array(sets, pa.binary())],
                                                 names=["c1", "c2", "shingles"])

    return run


def hash_batches(batches):
    """Every batch with the hashes of its texts' words, as __c1 and __c2."""
    for batch in batches:
        sig = []
        for _, off, data in text_slices(batch.column("text")):
            low = LOWER[data]
            starts, ends, first = words(off, low, NON_SPACE)
            sig.append(sequence_hashes(word_hashes(low, starts, ends), first))
        if sig:
            sig = np.concatenate(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig[:, 0]), pa.array(sig[:, 1])],
                                             names=[*batch.schema.names, "__c1", "__c2"])


def intersections(sets: list[np.ndarray], slice_cols: int = 8192) -> np.ndarray:
    """Matrix of the sizes of all intersections, by products of 0/1 matrices over
    the shingles that two sets or more hold."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    column = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, cols = owner[keep], column[inverse[keep]]
    order = np.argsort(cols, kind="stable")
    owner, cols = owner[order], cols[order]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(cols[-1]) + 1 if len(cols) else 0, slice_cols):
        a, b = np.searchsorted(cols, [low, low + slice_cols])
        m = np.zeros((len(sets), min(slice_cols, int(cols[-1]) + 1 - low)), np.float32)
        m[owner[a:b], cols[a:b] - low] = 1
        inter += m @ m.T
    inter[np.arange(len(sets)), np.arange(len(sets))] = sizes
    return inter


def verify_chunks(threshold: float):
    """One pair of chunks of one bucket: links and a connecting label per member."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, i, j = key
        cid = pdf["cid"].to_numpy()
        weight = pdf["copies"].to_numpy()
        sets = [np.frombuffer(s, _U) for s in pdf["shingles"]]
        inter = intersections(sets)
        sizes = np.array([len(s) for s in sets], np.float64)
        union = sizes[:, None] + sizes[None, :] - inter
        linked = inter.astype(np.float64) >= threshold * union
        if i != j:  # within a chunk: the task of (i, i)
            linked &= (pdf["chunk"].to_numpy()[:, None] != pdf["chunk"].to_numpy()[None, :])
        # only pairs for which this is the first common bucket
        earlier = [np.asarray(b)[np.asarray(b) < bucket] for b in pdf["buckets"]]
        ids, inverse = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(ids):
            member = np.zeros((len(cid), len(ids)), np.float32)
            member[np.repeat(np.arange(len(cid)), [len(e) for e in earlier]), inverse] = 1
            linked &= (member @ member.T) == 0
        np.fill_diagonal(linked, False)
        links = linked.astype(np.float64) @ weight.astype(np.float64)
        label = np.arange(len(cid))
        np.fill_diagonal(linked, True)
        while True:
            low = np.where(linked, label[None, :], len(cid)).min(axis=1)
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        some = links > 0
        return pd.DataFrame({"cid": cid[some], "links": links[some].astype(np.int64), "label": cid[label[some]]})

    return run


def jaccard_groups(docs: DataFrame, k: int = 5, threshold: float = 0.8, target_recall: float = 0.9995,
                   max_hashes: int = 104, seed: int = 5) -> DataFrame:
    """``docs``: (id, text). Returns a row for each row of it: ``id``, the hash of its
    words (``c1``, ``c2``), ``n_links`` (other documents linked directly),
    ``component_id``, ``class_id`` (smallest id in the component) and ``copies``
    (documents with the same words)."""
    bands, rows = choose_bands(threshold, target_recall, max_hashes)
    signed = staged(docs.select("id", "text").mapInArrow(tidy(signature_batches(k, bands, rows, seed)),
                                                         "id long, c1 long, c2 long, bands array<long>"), "signatures")
    classes = signed.groupBy("c1", "c2").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("copies"),
                                             F.min("bands").alias("bands"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    banded = (classes.where("c1 <> 0 or c2 <> 0")  # no words: nothing to link but the class itself
              .select("cid", F.posexplode("bands").alias("band", "hash")))
    buckets = (banded.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("s2"))
        .where("n > 1").groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "hash")).alias("b"))
        .select("n", "b.band", "b.hash", F.monotonically_increasing_id().alias("bucket")))
    buckets = staged(buckets, "buckets")
    # The sides of these joins grow with the corpus: sort-merge at every size.
    held = staged(banded.join(buckets.hint("merge"), ["band", "hash"]).select("cid", "bucket", "n"), "held")
    lists = (held.groupBy("cid").agg(F.collect_list("bucket").alias("buckets"))
             .join(classes.select("cid", "c1", "c2", "min_id", "copies"), "cid"))
    lists = staged(lists, "lists")
    wanted = lists.select(F.col("min_id").alias("rep")).distinct()
    texts = (docs.select("id", "text").join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
             .mapInArrow(tidy(set_batches(k)), "c1 long, c2 long, shingles binary"))
    # an id may stand on other rows too, and a row may be repeated
    sets = (texts.join(lists.hint("merge"), ["c1", "c2"]).groupBy("c1", "c2", "cid", "copies", "buckets")
            .agg(F.min("shingles").alias("shingles")).select("cid", "copies", "buckets", "shingles"))
    sets = staged(sets, "sets")

    n_chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    pairs = (held.withColumn("chunk", F.pmod(F.xxhash64("cid"), n_chunks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
             .select("cid", "bucket", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    found = (pairs.join(sets.hint("merge"), "cid").groupBy("bucket", "i", "j")
             .applyInPandas(verify_chunks(threshold), "cid long, links long, label long"))
    found = staged(found, "links")

    component = connected_components(found.select(F.col("cid").alias("a"), F.col("label").alias("b")))
    per = (classes.drop("bands").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
           .join(component.withColumnRenamed("id", "cid"), "cid", "left")
           .withColumn("component_id", F.coalesce("component_id", "cid")))
    least = per.groupBy("component_id").agg(F.min("min_id").alias("class_id"))
    per = per.join(least, "component_id").select(
        "c1", "c2", "class_id", "component_id", "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("id", "c1", "c2").join(per, ["c1", "c2"])


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest
    doc_id stays, once (a null id only if the group has no other)."""
    groups = jaccard_groups(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
    best = (groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "c1", "c2")).alias("b"))
            .select(F.col("b.id").alias("__id"), F.col("b.c1").alias("__b1"), F.col("b.c2").alias("__b2")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    hashed = docs.mapInArrow(tidy(hash_batches), f"{fields}, __c1 long, __c2 long")
    kept = hashed.join(best.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__c1") == F.col("__b1"))
                       & (F.col("__c2") == F.col("__b2")), "left_semi")
    once = Window.partitionBy("doc_id", "__c1", "__c2").orderBy("text")
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return jaccard_groups(docs).select(F.col("id").alias("doc_id"), "class_id", F.col("n_links").cast("long"),
                                       (F.col("copies") - 1).alias("exact_copies"))
