"""Cases in which a training-data operator once gave less than the whole result."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from odotrail.llm import ann, bpe, minhash, quality, queries, toxicity
from odotrail.llm.common import bounded_rows
from odotrail.llm.graph import connected_components

from .test_llm import brute, brute_components, documents, near_copies


def neighbours(df, k):
    got = {}
    for r in ann.nearest(df, F.lit(True), k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    return {q: [i for _, i in sorted(found)] for q, found in got.items()}


def test_neighbours_with_many_equal_scores(spark):
    r = np.random.default_rng(3)
    x = np.array([[n >> b & 1 for b in range(8)] for n in range(1, 181)], float)
    ids = r.permutation(180).tolist()
    got = neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), 5)
    assert got == {ids[q]: [i for i, _ in brute(x, ids, q, 5)] for q in range(180)}


def test_neighbours_with_a_repeated_row(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5)
    assert got[2] == [1, 3, 4] and got[3] == [1, 2, 4]


def test_neighbours_of_ids_with_many_vectors(spark):
    r = np.random.default_rng(8)
    near = [(1, (np.array([5.0, 0, 0]) + r.normal(size=3) / 50).tolist()) for _ in range(400)]
    far = [(i, r.normal(size=3).tolist()) for i in range(2, 60)]
    df = spark.createDataFrame([*near, *far, (0, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    for group in (8 << 20, 256 * 24):  # one piece a part; several
        got = [(x["rank"], x.vec_id) for x in ann.nearest(df, F.col("vec_id") == 0, k=30, target=1.0, group_bytes=group).collect()]
        best = sorted({i: max(v[0] for j, v in [*near, *far] if j == i) for i in range(1, 60)}.items(), key=lambda p: (-p[1], p[0]))
        assert [i for _, i in sorted(got)] == [i for i, _ in best[:30]]


def test_neighbours_of_many_leaves_and_queries(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 8)) * r.lognormal(size=(3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(df, F.col("vec_id") % 10 == 0, k=10, leaf_rows=50, group_bytes=256 * 64, salt_queries=70).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    assert len(got) == 300 and all([n for n, _ in sorted(f)] == list(range(1, 11)) for f in got.values())
    recall = [len({i for _, i in got[q]} & {i for i, _ in brute(x, list(range(3000)), q, 10)}) / 10 for q in got]
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("limit", [1000, 10])  # 10: there are large groups too
def test_near_duplicates_of_repeated_rows(spark, limit):
    words = [f"q{i}" for i in range(120)]
    texts = [*near_copies(2), " ".join(words), " ".join([*words, "more"])]
    twice = [len(texts) - 2, len(texts) - 1] * 2
    docs = documents(spark, texts).union(documents(spark, [texts[i] for i in twice], twice))
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, 3, 85, group_nodes=limit).select("doc_id", "n_shingles", "component_id", "kept").collect())
    once = [(i, n, root, i == root) for i, (n, root) in enumerate(brute_components(texts, 3, 85))]
    assert got == sorted(once + [once[i] for i in twice])


def test_fitting_samples_are_bounded(spark):
    ids = [None] * 200 + [7] * 200 + list(range(1000, 1200))  # one id, null or not, holds a third of the rows
    docs = documents(spark, [f"text {i}" for i in range(600)], ids).select("doc_id", "text", "lang")
    more = docs.union(documents(spark, ["copy"] * 400, [8] * 400).select("doc_id", "text", "lang"))
    taken = [[sorted(tuple(r)[1:] for r in bounded_rows(d.repartition(parts), 60, "text").collect()) for parts in (2, 5)] for d in (docs, more)]
    assert all(len(t) == 60 for pair in taken for t in pair) and all(a == b for a, b in taken)
    assert sum(t == "copy" for t, _ in taken[1][0]) <= 1
    assert bounded_rows(docs, 600, "text").count() == 600 and bounded_rows(docs.limit(0), 5, "text").count() == 0
    few = bounded_rows(docs, 600, "text", max_bytes=640).collect()  # by bytes; and no text is over a 64th of them
    assert 60 < len(few) <= 90 and sum(len(r.text) for r in few) <= 640
    assert bounded_rows(docs.withColumn("text", F.repeat("text", 100)), 600, "text", max_bytes=640).count() == 0
    tongues = docs.withColumn("lang", F.when(F.col("doc_id") == 1000, "fr").when(F.col("doc_id") != 7, "en"))
    by = bounded_rows(tongues, 20, "text", by="lang").groupBy("lang").count().collect()
    assert {(r["lang"], r["count"]) for r in by} == {("en", 10), ("fr", 1)}
    assert bounded_rows(tongues, 20, "text", by="lang", max_groups=1).select("lang").distinct().count() == 1


def test_classifiers_of_repeated_and_null_ids(spark):
    docs = documents(spark, ["good prose here"] * 40 + ["bad words here"] * 40 + ["good prose here"], [1] * 40 + [None] * 20 + [2] * 20 + [1])
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(docs, module.fit(docs, labels, max_texts=30)).collect()
        assert len(got) == 81 and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in docs.select(queries.held_out(3, 1).alias("held_out")).collect()} <= {True, False}


def test_bpe_of_long_white_space(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = bpe.load(path, public_tokenizers.PATTERN)[0]
    blank = encoding._encode_single_piece
    long = [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 500_000 + "b", "　" * 400_000 + " x"]
    want = [blank(long[0]), blank(long[1]), [*encoding.encode_ordinary("a"), *blank(long[2][1:-2]), *encoding.encode_ordinary("\nb")], [*blank("　" * 400_000), *encoding.encode_ordinary(" x")]]
    short = [t[:20_000] + t[-20_000:] for t in long]  # the library itself can do these
    docs = documents(spark, long + short + long[:1], [None, *range(1, 8), 1])
    got = bpe.encode_decode(docs.withColumn("n_tokens", F.lit("clash")), path, public_tokenizers.PATTERN).collect()
    assert len(got) == 9 and all(r.round_trip for r in got)
    assert sorted(r.ids for r in got) == sorted([*want, *map(encoding.encode_ordinary, short), want[0]])


def test_bpe_cuts_where_the_pattern_does(monkeypatch):
    encoding = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)[0]
    monkeypatch.setattr(bpe, "_RUN", re.compile(bpe._RUN.pattern.replace("16384", "3")))
    monkeypatch.setattr(bpe, "RUN_CHARS", 3)
    r = random.Random(4)
    for _ in range(500):
        t = "".join(r.choice([" ", "\n", "　", "\x1c", "\x85", "a", "é", "1", ".", "'s"]) * r.choice([1, 1, 2, 3, 7]) for _ in range(r.randint(0, 30)))
        assert bpe.encode(encoding, t) == encoding.encode_ordinary(t)


def test_components_of_binary_nodes_around_a_hub(spark):
    name = lambda i: i.to_bytes(16, "big")
    links = [(name(50_000), name(i)) for i in range(40_000, 40_300)] + [(name(1), name(i)) for i in range(60_000, 60_300)] + [(name(3), name(2)), (name(4), name(3)), (None, name(9))]
    got = {bytes(x.node): bytes(x.component) for x in connected_components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    want = {name(i): name(40_000) for i in [*range(40_000, 40_300), 50_000]} | {name(i): name(1) for i in [1, *range(60_000, 60_300)]} | {name(i): name(2) for i in (2, 3, 4)}
    assert got == want


def test_near_duplicates_of_one_large_group(spark):
    """Buckets and components of more nodes than a shuffled key may have."""
    r = random.Random(31)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{r.randint(0, 10**6)}" for _ in range(50)) for _ in range(20)]
    r.shuffle(texts)
    for limit in (1000, 40):
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(spark, texts), 3, 85, group_nodes=limit).collect()}
        assert [got[i] for i in range(len(texts))] == [root for _, root in brute_components(texts, 3, 85)]
