import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import language_id as m
from lakeloom.llm.textbytes import text_slices

from .helpers import documents, sf_documents

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_columns(spark):
    got = {r["doc_id"]: r for r in m.op1_language_id(spark, SF01).collect()}
    truth = {r["doc_id"]: r["lang"] for r in sf_documents(spark, SF01).collect()}
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) <= 0.01 * len(got)


EN, DE = "the house is on the hill with trees ", "das haus steht auf dem hügel mit bäumen "
ROWS = ([(i, EN * (1 + i % 3), "en") for i in range(0, 60, 2)] + [(i, DE * (1 + i % 3), "de") for i in range(1, 60, 2)]
        + [(100, None, "en"), (101, "", "de"), (102, "12 34 ... — 56", "en"), (103, "THE HOUSE", None), (104, DE * 4000, None),
           (None, EN, "fr"), (105, "ж", None), (7, DE, "de"), (7, DE, "de")])


def test_awkward_rows(spark):
    docs = documents(spark, ROWS)
    model = m.fit(docs)
    assert model.langs == ["de", "en"]  # the row without an id trains nothing
    rows = {(r["doc_id"], r["text"]): r for r in m.identify(docs, model).collect()}
    for key in ((100, None), (101, ""), (102, "12 34 ... — 56")):
        assert (rows[key]["__lang"], rows[key]["__score"], rows[key]["__rejected"]) == ("und", 0.0, True)
    assert rows[(103, "THE HOUSE")]["__lang"] == "en" and rows[(104, DE * 4000)]["__lang"] == "de"
    assert rows[(105, "ж")]["__lang"] in model.langs
    out = m.keep_identified(spark, docs, "")
    assert out.dtypes == docs.dtypes
    kept = [r["doc_id"] for r in out.collect()]
    assert not {100, 101, 102} & set(kept) and kept.count(7) == 3
    assert m.keep_identified(spark, docs.limit(0), "").count() == 0


def test_no_labels_means_und(spark):
    docs = documents(spark, [(1, EN, None), (2, DE, None)])
    assert {r["__lang"] for r in m.identify(docs, m.fit(docs)).collect()} == {"und"}


def test_subwords_do_not_depend_on_neighbours():
    texts = ["", "A b", None, "été!! Été", "x", "   ", "trees, trees"]
    (_, off, data), = text_slices(pa.array(texts))
    s, first = m.subwords(off, data)
    for i, t in enumerate(texts):
        (_, o, d), = text_slices(pa.array([t], pa.string()))
        own, f = m.subwords(o, d)
        assert sorted(own[f[0]:f[1]]) == sorted(s[first[i]:first[i + 1]])
    assert len(s[first[4]:first[5]]) == 1 and first[5] == first[6]


def test_folded_layer_equals_averaging_first():
    rng = np.random.default_rng(0)
    wide = m.Model([str(i) for i in range(m.DIM + 1)], rng.normal(size=(m.BUCKETS, m.DIM)), rng.normal(size=(m.DIM, m.DIM + 1)), rng.normal(size=m.DIM + 1))
    few = m.Model(wide.langs[:3], wide.table, wide.layer[:, :3], wide.bias[:3])
    (_, off, data), = text_slices(pa.array([EN, DE, "q"]))
    a = wide.scores(off, data)[0][:, :3]
    assert np.allclose(a / a.sum(axis=1, keepdims=True), few.scores(off, data)[0])


JUNK = [(900_001, "xqzt vbnm qwrt zxcv plkj " * 3, None), (900_002, "Съешь же ещё этих мягких французских булок да выпей чаю", None),
        (900_003, "これは学習していない文字で書かれた長めの文章ですこれは学習していない文字で書かれた長めの文章です", None)]


@pytest.mark.parametrize("left_out", ["en", "es"])
def test_language_left_out_of_training_is_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 4 = 0")
    model = m.fit(docs.where(F.col("lang") != left_out))
    assert left_out not in model.langs
    junk = spark.createDataFrame(JUNK, "doc_id long, text string, lang string")
    rows = m.identify(docs.unionByName(junk), model).where("length(text) > 0").groupBy("lang").agg(
        F.avg(F.col("__rejected").cast("double")).alias("share")).collect()
    share = {r["lang"]: r["share"] for r in rows}
    assert share[left_out] >= 0.9 and share[None] == 1.0, share
    assert all(v <= 0.01 for k, v in share.items() if k in model.langs), share
