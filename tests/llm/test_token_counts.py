"""Token counts against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odotrail.llm import token_counts
from odotrail.llm.token_counts import ByteLevelBpe

from .test_llm import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = ByteLevelBpe.load(PATH)
PARTS = [" ", "  ", "\n", "\t", "\r\n", "　", "\xa0", "\x85", "\x1c", "a", "B", "the", "don", "'s", "'t", "'ll", "'re", "'", "''s", " 's", "'S", "é", "ß", "中文字", "한국", "🙂", "é", "1", "23", "٣", "½", ".", ",", "!?", "--", "_", "<|endoftext|>", "<|endof", "text|>", "<|endoftext|>s", "\0", "x" * 9, "\U0001f1e9", "ǅ", "ↈ", "\U00016d40"]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def counted(texts):
    raw = [t.encode() for t in texts]
    return MODEL.count(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)).tolist()


def test_equals_library_on_random_texts():
    r = random.Random(1)
    for size in (1, 3, 8, 40):
        texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, size))) for _ in range(600)]
        assert counted(texts) == library(texts)
    assert counted([]) == [] and counted(["", "", ""]) == [0, 0, 0]


def test_equals_library_on_all_characters():
    r = random.Random(2)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = sorted({*points[:3000], *r.sample(points, 20_000)})
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}'{chr(c)}" for c in some[i : i + 50]) for i in range(0, len(some), 50)]
    assert counted(texts) == library(texts)


@pytest.mark.parametrize("limit", [1, 20, 256])
def test_equals_library_on_long_sequences(monkeypatch, limit):
    monkeypatch.setattr(token_counts, "LONG", limit)
    r = random.Random(3)
    texts = ["a" * n for n in range(40)] + ["ab" * 300 + "a", "aab" * 200, "x" * 5000, "中" * 700, "=" * 1000, "0" * 999, " " * 3000 + "x", "\n" * 501]
    texts += ["".join(r.choice("abcdet") for _ in range(n)) for n in (100, 500, 3000)] + ["".join(chr(r.randint(0x4E00, 0x5000)) for _ in range(2000))]
    assert counted(texts) == library(texts)


def test_a_million_letters():
    r = random.Random(4)
    text = "".join(r.choice("etaoinshr") for _ in range(1_000_000))
    assert counted([text]) == library([text])


def test_documents(spark, monkeypatch):
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(3000))
    texts = [None, "", "The cat's\n\n hat <|endoftext|> 12", long, long + "<|endoftext|>", "  " * 700, long]
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 500)
    docs = documents(spark, texts, [None, 1, 2, 3, 4, 4, 3]).withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH, keep=("source",)).collect())
    want = library([t or "" for t in texts])
    assert got == sorted((len((t or "").encode()), n, n > 1024) for t, n in zip(texts, want, strict=True))
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []
    data = np.frombuffer(long.encode(), np.uint8)
    assert len(token_counts.pieces(data, 500)) > 10


def test_invalid_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FFC3286220E28228') as string) as text")
    valid = docs.select(F.make_valid_utf8("text").alias("t")).first().t
    got = token_counts.count_tokens(docs, PATH).first()
    assert (got.n_bytes, got.n_tokens) == (len(valid.encode()), library([valid])[0])


def test_other_models_are_refused():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"ignore_merges": True}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError):
            ByteLevelBpe(spec | change)
