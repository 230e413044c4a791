"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from odotrail.llm import lexical

from .test_llm import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(texts, items, k=10, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    bags = [Counter(terms(t)) for t in texts]
    n = [sum(b.values()) for b in bags]
    many, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for b in bags for t in b)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for i, b in enumerate(bags):
            s = 0
            for t in terms(text):
                if b[t]:
                    w = math.floor(1000 * math.log((2.0 * many + 2) / (2.0 * df[t] + 1)))
                    s += w * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * (25 + 75 * n[i] * many // length)))
            if s > 0:
                scored.append((-s, ids[i] is None, ids[i]))
        out += [(item_id, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda p: (p[0], p[1], p[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, texts, items, ids=None, **options):
    docs = documents(spark, texts, ids).withColumns({"shard": F.lit("clash"), "term": F.lit(1)})
    rows = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def corpus(seed, n, words=200):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "中文", "Word", "don"]
    pick = lambda: vocabulary[min(len(vocabulary) - 1, int(r.expovariate(1 / 25)))]
    texts = [r.choice([" ", ", ", "'s-", "\n"]).join(pick() for _ in range(r.choice([1, 5, 30, 90]))) for _ in range(n)]
    return texts, [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 8, 25])))) for i in range(25)]


@pytest.mark.parametrize("shard_bytes, group_items", [(16 << 20, 2000), (3000, 7)])
def test_equals_brute_force(spark, shard_bytes, group_items):
    texts, items = corpus(1, 700)
    want = brute(texts, items)
    assert len(want) > 200
    assert found(spark, texts, items, shard_bytes=shard_bytes, group_items=group_items) == want


def test_ties_repeats_and_nulls(spark):
    texts = ["same words here"] * 40 + [None, "", " .,!", "SAME Words", "other", "x" * 10_000 + " same", "same " * 30_000]
    items = [(1, "same here"), (1, "same here"), (1, "words"), (2, None), (3, ""), (4, "absent"), (None, "other same same")]
    assert found(spark, texts, items, k=12) == brute(texts, items, 12)
    ids = [*range(100, 140), 5, 6, 7, None, None, 9, 9]
    assert found(spark, texts, items, ids, k=45, shard_bytes=100) == brute(texts, items, 45, ids)
    assert found(spark, [], items) == [] and found(spark, texts, []) == []


def test_index_can_be_searched_again(spark):
    texts, items = corpus(2, 200)
    docs = documents(spark, texts)
    index = lexical.build_index(docs, shard_bytes=2000)
    assert index.filter("term is null").count() > 3
    for part in (items[:5], items[5:]):
        got = lexical.search(docs, spark.createDataFrame(part, "item_id long, text string"), index=index).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(texts, part)


def test_blocks_are_rejected_before_decompression():
    """A rare term's documents settle the best; of the common term's blocks only those that could hold them are read."""
    n = 40_000
    texts = ["common filler words"] * n
    for i in range(30_000, 30_012):
        texts[i] = "common rare rare rare"
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    lists, gain = {}, None
    for b in lexical.index_shard(0, np.arange(n), data, bounds):
        for r in b.to_pylist():
            if r["term"] is None:
                gain = lexical.Gain(np.frombuffer(r["best"], np.uint32).astype(np.int64), r["df"], r["terms"])
            else:
                lists[r["term"]] = lexical.Postings(r["blocks"], r["best"], r["data"], 1000 if r["term"] == b"rare" else 20, gain)
    docs, _ = lexical.best_documents([(lists[b"rare"], 1), (lists[b"common"], 1)], 10, np.zeros(n, np.int64))
    assert docs.tolist() == list(range(30_000, 30_010))
    assert len(lists[b"common"].first) == -(-n // lexical.BLOCK) and len(lists[b"common"].known) <= 2
