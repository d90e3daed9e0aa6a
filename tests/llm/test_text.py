"""Words, token transducer, packing plan and language: against plain Python and the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tesserine.llm import language, packing, token_counts, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\t\n\x0b\x0c\r ", "one", "A b  C\nd", "é\u00a0ü a\x1cb", "x" * 5000, None, "<|endoftext|>a<|startoftext|>", "it's we'll'd ABC's 123 4½", "ΑΣ Σ İ á ́x　a\x85d",
       "日本語 한국어 🙂🙂 …—", "\0\x01 �", "<|ENDOFTEXT|>", "antidisestablishment " * 300]


def strings(n, seed=3):
    rng = random.Random(seed)
    letters = list("abcdefghij'AB01 .,!é漢ßÀñ́​ \n")
    return ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_words_and_shingles(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    texts = ODD + strings(300)
    column = pa.chunked_array([pa.array(["cut off", *texts[:7]])[1:], pa.array(texts[7:], pa.string())])
    hashed, seen = {}, []
    for b in words.blocks(column):
        h = b.hashes(lower=True)
        shingles, at = b.shingles(h, 3)
        for i in range(b.n):
            mine = (texts[b.first + i] or "").encode().lower().split()
            assert len(mine) == b.words[i + 1] - b.words[i]
            for w, x in zip(mine, h[b.words[i]:b.words[i + 1]], strict=True):
                assert hashed.setdefault(w, x) == x
            want = [tuple(mine[k:k + 3]) for k in range(len(mine) - 2)] or ([tuple(mine)] if mine else [])
            seen += list(zip(want, shingles[at[i]:at[i + 1]], strict=True))
    assert len(set(hashed.values())) == len(hashed)
    assert len({s for s, _ in seen}) == len({int(x) for _, x in seen}) == len(set(seen))


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_token_counts_are_the_librarys(monkeypatch, library, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    machine = token_counts.TextTransducer(VOCABULARY)
    texts = [t or "" for t in ODD] + strings(2000)
    assert [machine.count(t) for t in texts] == [(len(t.encode()), len(e.ids)) for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)]


def test_states_and_words_are_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "WORDS", 10)
    machine = token_counts.TextTransducer(VOCABULARY)
    for t in strings(300):
        assert machine.count(t)[1] == len(library.encode(t, add_special_tokens=False).ids)
    assert len(machine.words) <= 10 and len(machine.bpe.states) < 50 + 60


def test_compose_is_associative():
    machine = token_counts.TextTransducer(VOCABULARY)
    a, b, c = (machine.chunk(x) for x in (b"the qui", b"ck", b"er fox jumps"))
    assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


def test_encoder_gives_the_librarys_ids(monkeypatch, library):
    monkeypatch.setattr(packing, "MEMO", 20)
    encode = packing.encoder(VOCABULARY)
    for t in [t or "" for t in ODD] + strings(500):
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    whole = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    assert np.frombuffer(whole("a  b\n"), "<u4").tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("a  b\n", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [1, 10, 64])
def test_plan_is_best_fit_over_documents(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, left in enumerate(bins) if left >= n]
            if fits:
                bins[min(fits, key=bins.__getitem__)] -= n
            else:
                bins.append(capacity - n)
        placed = {}
        for length, first, end, sequence, per, offset in packing.plan_slots({n: lengths.count(n) for n in set(lengths)}, capacity):
            for r in range(end - first):
                placed.setdefault(sequence + r // per, []).append((offset + r % per * length, length))
        assert len(placed) == len(bins) and sum(map(len, placed.values())) == len(lengths)
        for v in placed.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= capacity


def test_packing_documents(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat " * 3000, "x"), (3, "again", "x"), (4, "a b c", "x"), (None, "no id", "x"), (5, "a b c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs, VOCABULARY, capacity=512, with_ids=True)
    pieces = got.collect()
    assert sum(p.length for p in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length <= 2048 for p in pieces)
    for s in packing.sequences(got).collect():
        assert s.length <= 512 and len(s.ids) == 4 * s.length
    joined = b"".join(p.ids for p in sorted((p for p in pieces if p.doc_id == 3 and (p.piece > 0 or p.length > 2)), key=lambda p: p.piece))
    assert np.frombuffer(joined, "<u4").tolist() == [*library.encode("the cat " * 3000, add_special_tokens=False).ids, 0]
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_token_count_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, "a b", 7), (None, "", 7)], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, VOCABULARY, limit=1).fillna(-1, ["doc_id"]).collect())
    assert got == [(-1, 0, 0, False), (1, 0, 0, False), (1, 3, 2, True)]
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_language_cases(spark):
    train = spark.createDataFrame([(i, f"the house and the garden {i} were with them", "en") for i in range(40)] + [(100 + i, f"das haus und der garten {i} waren bei ihnen", "de") for i in range(40)]
                                  + [(300, "zzz", None), (301, None, "fr")], "doc_id long, text string, lang string")
    pools = language.learn(train)
    assert [n for n, _ in pools] == ["de", "en"]
    rows = [(1, "der garten und das haus"), (2, "the garden with the house"), (3, None), (4, ""), (5, "123 ... ###"), (6, "«—»"), (7, "the garden " * 50_000), (2, "the garden with the house")]
    docs = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, score double")
    got = language.identify(docs, pools).collect()
    assert [r.lang_pred for r in got] == ["de", "en", "und", "und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got) and [r.rejected for r in got] == [False, False, True, True, True, True, False, False]
    assert {r.lang_pred for r in language.identify(docs, []).collect()} == {"und"}
    assert language.learn(train.limit(0)) == [] and language.identify(docs.limit(0), pools).count() == 0


def test_language_accuracy_held_out(spark):
    from tesserine.llm.queries import op10_language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = op10_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
