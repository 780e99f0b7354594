import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lakeloom.llm import packing, token_counts
from lakeloom.llm.common import scratch
from lakeloom.llm.word_tokens import WordTokenizer

from .helpers import SF, documents, sf_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "it's 'sad ''s \"'s don't they'll we've I'M I'D l'homme 'tis x '", "a'1'2's", "ÀÉÎ ß ẞ İI ıŸ", "x<|endoftext|>y <|startoftext|>",
       "1234 ²³ ¼½ ª º µ", "日本語 текст Σας ΣΑΣ", "a\x00b\x07c\x1cd\x85e\xa0f g", "é é Å", "\t\n\r x\x0by\x0cz", "!!!***$$$ %%% a#b#c '''s's",
       "''ll 'll'll 'LL'RE", "soft\u00adhy", "😀😀 ok", "'s", "'", "'r", "'re", "'l", "end'"]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_batches_give_the_ids_of_the_tokenizer(special_as_text):
    rnd = random.Random(0)
    texts = ODD + ["".join(rnd.choice("ab stremvld'''’\"1²3 .,-éÉÀñß\n\t<|>İ") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    w = WordTokenizer(PATH, special_as_text)
    assert w.by_word
    for text, ids in zip(texts, w.encode(texts)):
        assert ids.tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("lakeloom.llm.word_tokens.CACHE_WORDS", 50)
    w = WordTokenizer(PATH)
    for i in range(6):
        text = " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(26))
        assert w.encode([text])[0].tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(w.known) <= 50


def test_other_tokenizer_files_are_used_whole():
    w = WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not w.by_word
    assert w.encode(["Hi there"])[0].tolist() == w.tokenizer.encode("Hi there", add_special_tokens=False).ids


def test_new_words_go_through_the_model_alone():
    w = WordTokenizer(PATH)
    text = "Zwölf NAÏVE Boxkämpfer's l'été ''re ß½µ x²y £5 ¿qué? it's _a_ 'LL" + " überlangeswort" * 3
    want = w.tokenizer.encode(text, add_special_tokens=False).ids
    w.tokenizer = None  # its normaliser and splitter cost twice what merging a word costs
    assert w.encode([text])[0].tolist() == want


def test_cache_grows_with_its_words():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcdefgäéñ") for _ in range(rnd.randint(2, 9))) for _ in range(6000)})
    w = WordTokenizer(PATH)
    for _ in range(2):
        for i in range(0, len(words), 700):
            text = " ".join(words[max(i - 300, 0):i + 700])
            assert w.encode([text])[0].tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(w.known) == len(set(w.known.tolist())) == len(words)


def test_files_with_added_words_are_used_whole(tmp_path):
    spec = WordTokenizer(PATH).tokenizer
    spec.add_tokens(["oxk"])
    spec.save(str(tmp_path / "added.json"))
    w = WordTokenizer(str(tmp_path / "added.json"))
    assert not w.by_word
    assert w.encode(["Boxkämpfer oxk"])[0].tolist() == spec.encode("Boxkämpfer oxk", add_special_tokens=False).ids


ROWS = [(None, "a b c"), (-5, None), (7, ""), (7, "x " * 9000), (7, "x " * 9000), (2 ** 63 - 1, "q <|endoftext|> r"), (-2 ** 63, "日本 s")] + [
    (i, "word " * (i % 23)) for i in range(100, 160)]


def test_scan_of_flat_files(spark):
    w = WordTokenizer(PATH, special_as_text=True)
    want = sorted(((i, len(w.encode([t or ""])[0])) for i, t in ROWS), key=repr)
    path = scratch(spark, "t")
    token_counts.write_token_files(documents(spark, ROWS), path, PATH, docs_per_file=9)
    for block in (1, 3, 64, 1 << 19):
        assert sorted(map(tuple, token_counts.scan_token_files(spark, path, block).collect()), key=repr) == want
    assert spark.read.format("binaryFile").load(path).count() > 3
    empty = scratch(spark, "t")
    token_counts.write_token_files(documents(spark, ROWS).limit(0), empty, PATH)
    assert token_counts.scan_token_files(spark, empty).count() == 0


def test_token_counts_query(spark):
    w = WordTokenizer(PATH, special_as_text=True)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.op8_token_counts(spark, SF).collect()}
    assert got == {r["doc_id"]: len(w.encode([r["text"]])[0]) for r in sf_documents(spark).collect()}


def check_pieces(rows, docs, window=4096, end_id=2):
    """Every id in one piece, sequences gapless and full or a power of two."""
    w = WordTokenizer(PATH)
    want = sorted(np.append(w.encode([t or ""])[0], end_id).astype("<u4").tobytes() for _, t, *_ in docs)
    by_seq, total = {}, 0
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        total += r["length"]
        assert r["length"] > 0 and ("ids" not in r or zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"])
    assert total * 4 == sum(map(len, want))
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0
    return by_seq


def test_packing_of_awkward_rows(spark):
    rows = [r.asDict() for r in packing.pack(documents(spark, ROWS), PATH, window=256, shard_tokens=4000).collect()]
    check_pieces(rows, ROWS, 256)
    once = [r for r in ROWS if r[0] not in (7,)]
    w = WordTokenizer(PATH)
    for doc, text in once:
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in pieces) == np.append(w.encode([text or ""])[0], 2).astype("<u4").tobytes()
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert all(r["doc_tokens"] == sum(p["length"] for p in pieces) for r in pieces)
    assert packing.pack(documents(spark, ROWS).limit(0), PATH).count() == 0


def test_packing_query(spark):
    rows = [r.asDict() for r in packing.op6_lexical_packing(spark, SF).collect()]
    docs = [(r["doc_id"], r["text"]) for r in sf_documents(spark).collect()]
    assert len(check_pieces(rows, docs)) <= sum(r["length"] for r in rows) // 4096 + 12


def test_neighbours_come_in_order_of_bm25():
    rng = np.random.default_rng(0)
    topics = [np.arange(t * 50, t * 50 + 50) for t in range(4)]
    docs = [rng.choice(topics[i % 4], 20).astype("<u2") for i in range(40)]
    index = packing.ShardIndex(docs)
    sizes = np.array([20.0] * 40)
    for seed in (0, 5):
        want = np.zeros(40)
        for term in set(docs[seed].tolist()):
            df = sum(term in d for d in docs)
            for j, d in enumerate(docs):
                tf = int((d == term).sum())
                want[j] += np.log(1 + (40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[j] / 20)) if tf else 0
        assert np.allclose(index.scores(docs[seed]), want)
    by_seq = {}
    for doc, start, size, seq, _ in packing.fill_windows(docs, 64):
        by_seq.setdefault(seq, []).append(doc % 4)
    assert by_seq[0] == [0, 0, 0, 0]  # a window holds the seed's own topic while there is any


def test_used_documents_leave_the_index(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [np.minimum(rng.zipf(1.4, rng.integers(1, 60)), 3000).astype("<u2") for _ in range(120)]
    index = packing.ShardIndex(docs)
    assert (index.row >= 0).any() and (index.row < 0).any()  # common terms and others
    before = np.array([index.scores(d) for d in docs])
    for part in (rng.random(120) < 0.6, np.arange(120) % 3 == 0, np.zeros(120, bool)):
        wanted = np.isin(np.arange(120), index.left) & part
        index.keep(wanted)
        assert np.allclose([index.scores(d) for d in docs], before * wanted)
        assert len(index.doc) == sum(len(set(docs[i].tolist())) for i in np.flatnonzero(wanted))
    held = []
    scores = packing.ShardIndex.scores
    monkeypatch.setattr(packing.ShardIndex, "scores", lambda self, ids: held.append(len(self.left)) or scores(self, ids))
    got = list(packing.fill_windows(docs, 64))
    assert sum(n for _, _, n, _, _ in got) == sum(map(len, docs))
    assert held[-1] < 40 and sum(held) < 0.75 * 120 * len(held)


def test_statistics_are_those_of_all_documents(spark):
    w = WordTokenizer(PATH)
    rest = [packing.rest_of(np.append(w.encode([t or ""])[0], 2), 256) for _, t in ROWS]
    rest = [r for r in rest if len(r)]
    tokens = documents(spark, ROWS).repartition(5).mapInArrow(packing.token_batches(PATH, 2), "doc_id long, ids binary")
    stats = packing.corpus_survey(tokens, packing.id_type(w.size), w.size, 256)[0]
    assert stats.mean == sum(map(len, rest)) / len(rest)
    for term in {int(t) for r in rest for t in r}:
        df = sum(term in r for r in rest)
        assert np.isclose(stats.idf[term], np.log(1 + (len(rest) - df + 0.5) / (df + 0.5)))


def test_neighbours_meet_wherever_they_lie(spark):
    rnd = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = ["".join(rnd.choice(syllables) for _ in range(3)) for _ in range(600)]
    topics = [words[i * 20:i * 20 + 20] for i in range(30)]
    rows = []
    for i in range(900):  # 30 topics, dealt in turn
        rows.append((i, " ".join(rnd.choice(topics[i % 30] if rnd.random() < 0.7 else words) for _ in range(40))))
    rows += [(1000 + i, rows[i][1] + " also") for i in range(300)]  # near copies, far from the first
    got = packing.pack(documents(spark, rows).repartition(4), PATH, window=512, shard_tokens=12000).collect()
    check_pieces([r.asDict() for r in got], rows, 512)
    shards = {}
    for r in got:
        shards.setdefault(r["sequence_id"] >> 40, set()).add(r["doc_id"])
    assert len(shards) >= 8
    of = {d: s for s, ds in shards.items() for d in ds}
    assert sum(of[i] == of[1000 + i] for i in range(300)) >= 270
    docs_in = {}
    for r in got:
        docs_in.setdefault(r["sequence_id"], set()).add(r["doc_id"])
    pairs = [(a % 1000 % 30 == b % 1000 % 30) for ds in docs_in.values() for a in ds for b in ds if a < b]
    assert sum(pairs) >= 0.7 * len(pairs)


def test_workers_keep_no_power_tables():
    from lakeloom.llm import textbytes

    textbytes._power_tables(200_000)
    textbytes.give_back()
    assert len(textbytes._powers[0]) == 1
    assert len(textbytes._power_tables(10)[0]) == 10
