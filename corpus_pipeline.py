"""Corpus pipeline: language identification, line dedup, near-duplicate documents,
source mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``; the last returns the
packed pieces with their ids.

When a stage begins, its predecessor's result is written, so the tables that the
predecessor stored on the way are deleted (none that ``docs`` still reads). The last
stage's are left: its result may be read later."""

from __future__ import annotations

from lakeloom.llm.common import delete_path, staged, watching
from lakeloom.llm.language_id import keep_identified
from lakeloom.llm.line_dedup import dedup_stage
from lakeloom.llm.mixing import mix_stage
from lakeloom.llm.ngram_join import one_per_group
from lakeloom.llm.packing import pack_stage

_done: list[str] = []  # what stages whose result is written have stored


def _stage(name, function):
    def run(spark, docs, sf_dir):
        read = docs.inputFiles()
        for path in [p for p in _done if not any(p in f for f in read)]:
            delete_path(spark, path)
            _done.remove(path)
        with watching() as made:
            out = function(spark, docs, sf_dir)
        if function is not pack_stage:
            _done.extend(made)
        return out

    return name, run


STAGES = [
    _stage("language_id", keep_identified),
    _stage("line_dedup", dedup_stage),
    _stage("ngram_jaccard", one_per_group),
    _stage("mix_sources", mix_stage),
    _stage("packing", pack_stage),
]

# Stage 1 trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = staged(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
