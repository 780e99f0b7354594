"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte 3- and 4-grams of its words (A-Z lower-cased, runs
of letters and bytes above 127, one space at each end). They are hashed into
``BUCKETS`` rows of an embedding table; the mean of the rows goes through a linear
softmax. Table and layer are trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents (``train_rows``, every language with about
the same share). Prediction runs in the tasks over whole texts.

Rejection is calibrated on a held-out part of the sample, which also sets the softmax
temperature. A text is rejected on either of two grounds, each of which at most
``reject_rate`` of the rightly labelled held-out documents meet, less a margin:

* its probability is low (the margin is one unit of log odds);
* its subwords are strange. A subword is known if it occurs in the training part (2^20
  hashes tell subwords apart); the share of known ones in the held-out part is p, and a
  text with k known of n subwords scores (k - n p) / sqrt(n p (1 - p)). Text in a
  language or alphabet that was not learned falls far below (the margin is one unit),
  however sure the softmax is; a text of few subwords cannot.

Defined results: null text and text without a letter (Unicode L) are ``und`` with
score 0 and rejected; rows without a label or id train nothing (a null id counts as
not held out and not for training); without any labelled row every text is
``und``; an empty table gives no rows; extra columns are kept by the stage and not
read otherwise. Neither lang nor source nor id enters a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, uniform
from .registry import query, table
from .textbytes import ALNUM, LOWER, give_back, text_slices

BITS = 15
BUCKETS = 1 << BITS
FINE = 20  # bits of a subword's own hash; its bucket is the upper BITS of them
DIM = 16
SLICE = 500_000  # bytes of text whose subwords are held at once
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False
HAS_LETTER = regex.compile(r"\p{L}")


def subwords(offsets: np.ndarray, data: np.ndarray):
    """(subword hashes of FINE bits, first subword of each text) of a slice, text by text."""
    n = len(offsets) - 1
    # one space before each text and one after the last: words never cross texts
    low = LOWER[data]
    b = np.insert(np.where(LETTERS[low], low, 32).astype(np.uint32), offsets, 32)
    start = offsets + np.arange(n + 1)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    new = np.concatenate([[0], np.cumsum(keep)])
    b = b[keep]
    space = b == 32
    first = new[start]  # a text's first kept byte; its leading space may be the previous text's last
    out, at = [], []
    for size, salt in ((3, 0x85EBCA6B), (4, 0x27D4EB2F)):
        m = len(b) - size + 1
        if m <= 0:
            continue
        ok = ~space[1:1 + m].copy()
        for i in range(2, size - 1):
            ok &= ~space[i:i + m]
        key = np.full(m, salt & 0xFF, np.uint32)
        for i in range(size):
            key = (key ^ b[i:i + m]) * np.uint32(0x01000193)
        key = (key ^ (key >> np.uint32(15))) * np.uint32(salt)
        pos = np.flatnonzero(ok)
        out.append((key[pos] >> np.uint32(32 - FINE)).astype(np.int32))
        at.append(pos + 1)  # the first inner byte belongs to the text
    if not out:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    pos = np.concatenate(at)
    order = np.argsort(pos, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(pos[order], first)


def count_batches(batches):
    """Sparse subword counts of labelled texts: bytes of int32 hashes and float32 counts."""
    for batch in batches:
        idx, cnt = [], []
        for _, off, data in text_slices(batch.column("text"), SLICE):
            s, first = subwords(off, data)
            for a, b in zip(first[:-1], first[1:]):
                u, c = np.unique(s[a:b], return_counts=True)
                idx.append(u.astype(np.int32).tobytes())
                cnt.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("valid"), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())],
            names=["lang", "valid", "idx", "cnt"])


class Model:
    """Languages, embedding table, linear layer, temperature and threshold."""

    def __init__(self, langs, table_, layer, bias):
        self.langs, self.table, self.layer, self.bias = list(langs), table_, layer, bias
        self.temperature, self.threshold = 1.0, 0.0
        self.known, self.share, self.strange = np.ones(1 << FINE, bool), 1.0, -np.inf

    def familiarity(self, known, n):
        """How far the known subwords are from their usual share; 0 for no subwords."""
        sd = np.sqrt(np.maximum(n * self.share * (1 - self.share), 1.0))
        return (known - n * self.share) / sd

    def scores(self, offsets, data) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, a row for each text of the slice, and familiarity."""
        fine, first = subwords(offsets, data)
        s = fine >> (FINE - BITS)
        # the layer is linear: it may be applied to the table before averaging
        fold = len(self.langs) <= self.table.shape[1]
        source = self.table @ self.layer if fold else self.table
        mean = np.zeros((len(offsets) - 1, source.shape[1]))
        count = np.diff(first)
        some = np.flatnonzero(count)
        for j in range(source.shape[1]):
            if len(some):
                column = np.ascontiguousarray(source[:, j], dtype=np.float64)
                mean[some, j] = np.add.reduceat(column[s], first[some]) / count[some]
        logits = (mean if fold else mean @ self.layer) + self.bias
        seen = np.concatenate([[0], np.cumsum(self.known[fine])])
        return softmax(logits / self.temperature), self.familiarity(seen[first[1:]] - seen[first[:-1]], count)


def softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(sample, epochs: int = 12, rate: float = 2.0, batch: int = 64, reject_rate: float = 0.001, seed: int = 1) -> Model:
    """``sample``: rows (lang, valid, idx, cnt). SGD with a linearly falling rate."""
    langs = sorted({r["lang"] for r in sample})
    rng = np.random.default_rng(seed)
    model = Model(langs, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
                  np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    # the rows come in any order; the model must not depend on it
    sample = sorted((r for r in sample if len(r["idx"])), key=lambda r: (r["lang"], r["valid"], bytes(r["idx"]), bytes(r["cnt"])))
    number = {x: i for i, x in enumerate(langs)}
    fit = [r for r in sample if not r["valid"]] or sample
    held = [r for r in sample if r["valid"]] or fit

    def rows(part):
        x = np.zeros((len(part), BUCKETS), np.float32)
        for i, r in enumerate(part):
            count = np.frombuffer(r["cnt"], np.float32)
            x[i] = np.bincount(np.frombuffer(r["idx"], np.int32) >> (FINE - BITS), count / count.sum(), BUCKETS)
        return x, np.array([number[r["lang"]] for r in part])

    steps = epochs * -(-len(fit) // batch)
    step = 0
    for _ in range(epochs if fit else 0):
        order = rng.permutation(len(fit))
        for a in range(0, len(fit), batch):
            x, y = rows([fit[i] for i in order[a:a + batch]])
            h = x @ model.table
            p = softmax(h @ model.layer + model.bias)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            now = rate * (1 - step / steps)
            back = p @ model.layer.T
            model.layer -= now * (h.T @ p)
            model.bias -= now * p.sum(axis=0)
            # a bucket's mean gradient is small: each row of the table learns with a rate times its share of rows
            used = np.flatnonzero(x.any(axis=0))
            model.table[used] -= now * 40 * (x[:, used].T @ back)
            step += 1
    if held:
        logits, truth = [], []
        for a in range(0, len(held), batch):
            x, y = rows(held[a:a + batch])
            logits.append(x @ model.table @ model.layer + model.bias)
            truth.append(y)
        logits, truth = np.concatenate(logits).astype(np.float64), np.concatenate(truth)
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
                for t in np.geomspace(0.02, 20, 61)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(logits / model.temperature)
        good = p.argmax(axis=1) == truth
        right = np.sort(p.max(axis=1)[good])
        if len(right):
            low = min(float(right[int(len(right) * reject_rate)]), 1 - 1e-12)
            model.threshold = 1 / (1 + np.exp(1 - np.log(low / (1 - low))))
            model.known[:] = False
            for r in fit:
                model.known[np.frombuffer(r["idx"], np.int32)] = True
            counts = [(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["cnt"], np.float32)) for r in held]
            known = np.array([c[model.known[i]].sum() for i, c in counts])
            n = np.array([c.sum() for _, c in counts])
            model.share = float(known[good].sum() / n[good].sum())
            usual = np.sort(model.familiarity(known, n)[good])
            model.strange = float(usual[int(len(usual) * reject_rate)]) - 1
    return model


PREDICTION = "struct<lang:string,score:double,rejected:boolean>"


def predictor(model: Model):
    """Arrow function of texts: lang, score, rejected. Only the texts go to Python."""

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        n = len(texts)
        lang, score, usual = np.full(n, "und", object), np.zeros(n), np.zeros(n)
        for row, off, data in text_slices(texts, SLICE) if model.langs else ():
            p, usual[row:row + len(off) - 1] = model.scores(off, data)
            best = p.argmax(axis=1)
            lang[row:row + len(best)] = np.array(model.langs, object)[best]
            score[row:row + len(best)] = p[np.arange(len(best)), best]
        for i, text in enumerate(texts):
            if not text.is_valid or not HAS_LETTER.search(text.as_py()):
                lang[i], score[i] = "und", 0.0
        rejected = (lang == "und") | (score < model.threshold) | (usual < model.strange)
        give_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected.astype(bool))],
                                          names=["lang", "score", "rejected"])

    return predict


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, train_rows: int = 2400, valid_share: float = 0.25, seed: int = 1) -> Model:
    """Train on at most ``train_rows`` labelled documents (doc_id, text, lang) that
    are not held out. A document's key is its hash times the number of documents of
    its language; the smallest keys make the sample, so languages come evenly. The
    sample is drawn from ids and labels; only its own texts are moved. Of rows
    sharing an id the smallest label, then the smallest text counts."""
    pool = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull())
    ids = pool.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    per = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sample = (ids.join(per, "lang").withColumn("key", uniform(F.lit(seed), "doc_id") * F.col("n"))
              .orderBy("key", "doc_id").limit(train_rows).select("doc_id", "lang"))
    texts = (pool.join(F.broadcast(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang")  # at most train_rows ids
             .agg(F.min("text").alias("text")).where(F.col("text").isNotNull())
             .select("lang", (uniform(F.lit(seed + 1), "doc_id") < valid_share).alias("valid"), "text"))
    rows = texts.mapInArrow(count_batches, "lang string, valid boolean, idx binary, cnt binary").collect()
    return train(rows, seed=seed)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a column text) and ``__lang``, ``__score``, ``__rejected``."""
    return docs.withColumn("__p", predictor(model)(F.col("text"))).select(
        *docs.columns, F.col("__p.lang").alias("__lang"), F.col("__p.score").alias("__score"), F.col("__p.rejected").alias("__rejected"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go."""
    return identify(docs, fit(docs)).where("not __rejected").select(*docs.columns)


@query("op1_language_id")
def op1_language_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"),
                      F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))
