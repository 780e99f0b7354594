import random
import re

from lakeloom.llm import license_scan as m

from .helpers import SF, documents, lower, sf_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in m.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def base_part(r):
    return (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])


MIT = next(text for label, text in m.TEMPLATES if label == "mit")
BSD = next(text for label, text in m.TEMPLATES if label == "bsd")
ROWS = [(1, None), (2, ""), (3, " ... "), (4, "MIT License, mit-license; Mit\nLICENSE"), (5, "general public license general public license public"),
        (6, "the général public license"), (7, "x " * 40000 + "Apache License " * 2000), (8, "mit"), (8, "license mit"), (None, "mit license"),
        (9, MIT), (10, "before " + MIT.replace("free of charge", "free of any charge").upper() + " after"),
        (11, " ".join(MIT.split()[::-1])), (12, " ".join(MIT.split()[:9])), (13, MIT + " and " + BSD + " mit license"), (14, MIT), (14, MIT)]


def test_base_matches_brute_force_and_templates_add_labels(spark):
    docs = documents(spark, ROWS)
    out, spans = m.scan_licenses(docs)
    rows = out.collect()
    assert sorted(map(repr, ((r["id"], *base_part(r)) for r in rows))) == sorted(map(repr, ((i, *brute(t)) for i, t in ROWS)))
    labels = {r["id"]: (r["labels"], r["score"]) for r in rows}
    assert labels[9] == ("mit", 1.0) and labels[14] == ("mit", 1.0)
    assert labels[10][0] == "mit" and m.MIN_SCORE <= labels[10][1] < 1  # words were put in between
    assert labels[11][0] == "" and labels[12][0] == "" and labels[13][0] == "bsd,mit"
    first = {r["first"] for r in spans.where("label = 'bsd'").collect()}
    assert first == {len(WORD.findall(MIT)) + 1}
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_driver_documents_match_brute_force(spark):
    text = {r["doc_id"]: r["text"] for r in sf_documents(spark).collect()}
    rows = m.op7_license_scan(spark, SF).collect()
    assert {r["doc_id"]: base_part(r) for r in rows} == {i: brute(t) for i, t in text.items()}
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in rows if r["base_labels"])


def whole_chains(text):
    """Labels by the longest rising chain over all matches of the whole text."""
    w = WORD.findall(lower(text))
    at = {}
    for i in range(len(w) - 1):
        at.setdefault((w[i], w[i + 1]), []).append(i)
    out = set()
    for label, template in m.TEMPLATES:
        t = WORD.findall(lower(template))
        pairs = [(p, j) for j in range(len(t) - 1) for p in at.get((t[j], t[j + 1]), [])]
        if m.chain_length(pairs) >= m.MIN_SCORE * (len(t) - 1) - 1e-9:
            out.add(label)
    return out


def test_bodies_insertions_and_gaps(spark):
    r = random.Random(4)
    filler = lambda n: " ".join(r.choice(["alpha", "of", "the", "software", "beta", "use", "in", "and"]) for _ in range(n))
    rows, want = [], {}
    for i, (label, template) in enumerate(m.TEMPLATES * 2):
        w = template.split()
        if i >= len(m.TEMPLATES):  # two insertions of four words, or a word left out
            for _ in range(2):
                k = r.randint(2, len(w) - 2)
                w[k:k] = ["one", "two", "three", "four"]
            if len(w) > 40:
                del w[r.randint(5, 30)]
        text = filler(200) + " " + " ".join(w) + " " + filler(200)
        rows.append((i, text))
        want[i] = whole_chains(text)
        assert label in want[i] or i >= len(m.TEMPLATES)
    rows += [(100 + i, filler(400)) for i in range(10)]
    got = {x["id"]: set(x["labels"].split(",")) - {""} for x in m.scan_licenses(documents(spark, rows))[0].collect()}
    assert {i: got[i] for i in want} == want
    assert all(not got[i] for i in got if i >= 100)
    ends = [i for i in want if i >= len(m.TEMPLATES) and want[i]]
    assert len(ends) >= 0.8 * len(m.TEMPLATES)


def test_empty_table(spark):
    out, spans = m.scan_licenses(documents(spark, ROWS).limit(0))
    assert out.count() == 0 and spans.count() == 0


def test_chain_rises_in_both():
    assert m.chain_length([(0, 0), (1, 1), (5, 2), (6, 9), (7, 3)]) == 4
    assert m.chain_length([(0, 3), (0, 4), (0, 5)]) == 1 and m.chain_length([]) == 0
