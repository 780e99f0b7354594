import math
import re
from collections import Counter

import pytest

from lakeloom.functions.stemming import STOP_WORDS, stem
from lakeloom.operators import search

# Examples printed with the published algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radicalli radic vileli vile
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate
cease ceas controll control roll roll generalizations gener oscillators oscil dogs dog is is a a""".split()


def test_published_stems():
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    assert [(w, stem(w)) for w, _ in pairs] == pairs


TEXTS = ["The dog ran. The dogs ran!", "the the the", "A cat, running; cats & dogs", None, "", "Dogged café CAFÉS", "running runner runs ran"]


def brute(query, stop=STOP_WORDS):
    docs = [[stem(w) for w in re.findall("[a-z]+", (t or "").lower().replace("é", "e")) if w not in stop] for t in TEXTS]
    terms = {stem(w) for w in query.split()}
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in terms}
    out = {}
    for i, d in enumerate(docs):
        c = Counter(d)
        s = sum(math.log10((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms if c[t])
        if any(c[t] for t in terms):
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["the dog", "run cats", "cafe", "dog dogs running", "the", "zebra"])
def test_search_by_stems(spark, query):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    got = {r["id"]: r["score"] for r in search.text_search(df, "id", "t", query).collect()}
    assert got == pytest.approx(brute(query))


def test_stop_words_and_stems_are_options(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    assert {r["id"] for r in search.text_search(df, "id", "t", "the", stop_words=()).collect()} == {0, 1}
    assert {r["id"] for r in search.text_search(df, "id", "t", "dog", stemming=False).collect()} == {0}
    best = search.text_search(df, "id", "t", "dog", top_k=1).collect()
    assert [r["id"] for r in best] == [max(brute("dog"), key=lambda i: (brute("dog")[i], -i))]
