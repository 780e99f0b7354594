from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm.common import connected_components, staged
from lakeloom.llm.word_tokens import WordTokenizer

from .helpers import CLASHING, documents, words
from .test_line_dedup import brute as brute_lines
from .test_mixing import filled
from .test_ngram_join import brute as brute_groups
from .test_tokens import check_pieces

EN, DE = "the quick brown fox jumps over the lazy dog near the river bank", "der schnelle braune fuchs springt über den faulen hund am fluss"


def corpus():
    rng = np.random.default_rng(0)
    out = []
    for i in range(160):
        lang, base = ("en", EN.split()) if i % 2 else ("de", DE.split())
        text = "\n".join(" ".join(rng.choice(base, 12)) + f" {lang} {i} {j}" for j in range(1 + i % 5))
        out.append((i, text, lang, f"src{i % 3}" if i % 7 else None))
    out += [(200 + i, out[11][1], "en", "src0") for i in range(4)]                       # exact copies
    out += [(300, out[14][1] + " und noch etwas", "de", "src1"), (301, None, "en", "src1"), (302, "", "de", "src2"), (303, "123 456 .", "en", "src0"),
            (304, out[4][1] + "\nall of us share this line\n", "de", "src1"), (305, out[3][1] + "\nALL of us share this line", "en", "src2"),
            (None, out[20][1].replace(" 20 ", " twenty "), "de", "src2"), (5, out[5][1], "en", "src2")]
    return out


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = documents(spark, rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mix_sources", "packing"]
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, ""), "test")
        results.append([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])
        if name != "packing":
            assert out.dtypes == docs.dtypes
            assert {r["n_chars"] - len(r["text"] or "") for r in out.collect()} == {0}
        docs = out
    first, lines, groups, mixing, packing = results
    assert sorted(map(repr, lines)) == sorted(repr(r) for r in first if r[0] not in (301, 302, 303))
    assert sorted((repr((i, t)) for i, t, *_ in groups)) == sorted(repr((i, t)) for i, _, _, t in brute_lines(lines))
    kept = {(i, c) for i, _, c in brute_groups(groups) if i == c}
    assert Counter(r[0] for r in mixing) == Counter(i for i, _ in kept)
    sizes, taken = Counter(), Counter()
    for r in mixing:
        sizes[r[3]] += len(words(r[1]))
    for r in packing:
        taken[r[3]] += len(words(r[1]))
    for s, t in filled(sizes).items():
        assert abs(taken[s] - t) <= 1
    check_pieces([r.asDict() for r in docs.collect()], packing)
    w = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert docs.agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in w.encode([r[1] or "" for r in packing]))


def test_run_reads_documents_and_takes_an_empty_table(spark, tmp_path):
    documents(spark, corpus()).drop(*CLASHING).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_the_pipeline_and_one_query_of_each_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 60), (60, 80), (7, 7), (100, 60), (200, 300)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {60: 60, 80: 60, 100: 60, 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
