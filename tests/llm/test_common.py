"""Helpers of the training-data operators."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odotrail.llm import bpe, common, decontaminate, lexical, minhash, substring
from odotrail.llm.common import distinct_slices, word_hashes

from .test_llm import documents


def test_slices_of_equal_hash_are_told_apart(monkeypatch):
    words = [b"aa", b"ab", b"aa", b"b", b"", b"ab", b"c", b"b", b"aa", b""] * 3
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for block in (1 << 20, 3):
        monkeypatch.setattr(common.blocks, "__defaults__", (block,))
        for hashes in (common.word_hashes, lambda d, s, e, key=0: np.zeros(len(s), np.uint64)):
            monkeypatch.setattr(common, "word_hashes", hashes)
            first, of = distinct_slices(data, start, end)
            assert len(first) == len(set(words)) and all(words[first[k]] == w for k, w in zip(of, words, strict=True))
        monkeypatch.undo()


def thue_morse(bits):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_word_hashes():
    r = random.Random(1)
    texts = {bytes(r.choice(b"ab\0") for _ in range(n)) for n in [*range(1, 40)] * 60} | {t.encode() for t in thue_morse(12)}
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    end = np.cumsum(size)
    h, other = (word_hashes(data, end - size, end, key) for key in (0, 7))
    assert len(set(h.tolist())) == len(texts) and not (h == other).any()
    again = np.append(np.frombuffer(b"xyz", np.uint8), data)
    assert (word_hashes(again, end - size + 3, end + 3, 7) == other).all()


def test_words_that_polynomials_cannot_tell_apart(spark):
    one, two = thue_morse(12)
    common_words = [f"w{i}" for i in range(60)]
    docs = documents(spark, [one, two, one.upper(), " ".join([*common_words, one]), " ".join([*common_words[:30], two, *common_words[30:]]), " ".join([one] * 61), " ".join([two] * 61)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert [got[i][1] for i in range(3)] == [0, 1, 0] and got[5][1] == 5 and got[6][1] == 6
    removed = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()}
    assert removed == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}


def test_exact_sets():
    r = random.Random(3)
    for size in (1, 3, 5):
        texts = [" ".join(r.choice("a b A c dd".split()) for _ in range(n)) for n in (0, 1, 2, 3, 5, 9, 40, 40, 4)]
        raw = [t.encode() for t in texts]
        got, cut = minhash.exact_sets(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])), size)
        words = [t.lower().split() for t in texts]
        want = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
        sets = [set(got[s:e].tolist()) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        assert [len(s) for s in sets] == [len(s) for s in want] == np.diff(cut).tolist()
        assert all(len(a & b) == len(x & y) for a, x in zip(sets, want, strict=True) for b, y in zip(sets, want, strict=True))


def test_texts_that_are_not_utf8(spark):
    """They count as Spark's make_valid_utf8 gives them, and no task dies."""
    words = " ".join(f"w{i}" for i in range(55))
    bad = spark.sql(f"select id as doc_id, cast(concat(unhex('61FF20E228C3'), cast(' {words}' as binary), unhex('20F0')) as string) as text, 'en' as lang, 's' as source, 1L as n_chars from range(2)")
    valid = bad.select(F.make_valid_utf8("text")).first()[0]
    assert "\ufffd" in valid
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for r in bpe.encode_decode(bad, path, public_tokenizers.PATTERN).collect():
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(valid.encode()).hexdigest()
    cut = {r.doc_id: r for r in substring.remove_repeats(bad, with_text=True).collect()}
    assert cut[0].kept_text == valid and cut[0].n_removed == 0 and cut[1].n_removed == cut[1].n_words == len(valid.split())
    items = spark.createDataFrame([(1, words)], "item_id long, text string").union(bad.select(F.col("doc_id") + 5, "text"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(bad, items).collect()} == {(d, i) for d in (0, 1) for i in (1, 5, 6)}
    assert {r.component_id for r in minhash.near_duplicates(bad).collect()} == {0}
    assert {r.doc_id for r in lexical.search(bad, items.filter("item_id = 1")).collect()} == {0, 1}
    for name, stage in corpus_pipeline.STAGES[1:3] + corpus_pipeline.STAGES[4:]:
        assert stage(spark, bad, "").count() == 1 if name != "tokens" else 2


@pytest.mark.parametrize("n", [0, 1, 3])
def test_empty_words(n):
    first, of = distinct_slices(np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64))
    assert len(first) == min(n, 1) and of.tolist() == [0] * n
