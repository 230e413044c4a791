"""The training-data operators against brute force, exact round trips and held-out accuracy, and on edge cases."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odotrail.llm import ann, bpe, common, decontaminate, langid, minhash, quality, queries, substring, suffix, toxicity, urls
from odotrail.llm.common import utf8
from odotrail.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    relation = duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = sorted(tuple(r) for r in relation.select(*columns).fetchall()) if all(columns) else []
    key = lambda rows: sorted(rows, key=repr)
    assert key(got) == key(want)


# --- neighbours


def brute(x, ids, q, k):
    s = x @ x[q]
    order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


def test_neighbours_exact_on_one_leaf_with_copies(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 4))
    x[20:50] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, float("nan"), 0.0, 0.0]), (63, [1.0, None, 0.0, 0.0]), (64, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    got = {}
    for row in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        want = brute(x, list(range(60)), q, 5)
        assert [f[1] for f in sorted(found)] == [w[0] for w in want]
        assert [f[2] for f in sorted(found)] == pytest.approx([w[1] for w in want], abs=1e-12)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(df.filter("vec_id < 3"), F.lit(True), k=5)
    assert few.groupBy("query_id").count().agg(F.min("count")).first()[0] == 2


def test_neighbours_recall(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = sorted((r.vec_id, r.embedding) for r in v.collect())
    ids, x = [d[0] for d in data], np.array([d[1] for d in data])
    found = {}
    for r in queries.op1_neighbours(spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[ids[q]] & {i for i, _ in brute(x, ids, q, 20)}) / 20 for q in range(len(ids)) if ids[q] % 20 == 0]
    assert np.mean(hits) >= 0.9


# --- classifiers


def test_quality_toxicity_and_language_held_out(spark):
    """On held-out rows alone, of tables with enough labels to tell."""
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    language = queries.op3_language(spark, sf_dir).collect()
    held = [r for r in language if r.held_out and r.lang_pred != "und"]
    assert len(language) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in language)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    for query, label, folds, fold, limit in ((queries.op2_quality, "quality", 5, 0, 0.3), (queries.op4_toxicity, "toxic", 3, 1, 0.7)):
        scores = query(spark, sf_dir).collect()
        assert len(scores) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in scores)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in scores)
        seen = [(r.predicted, r.score, labels[r.doc_id][label]) for r in scores if r.held_out and r.doc_id in labels]
        y, predicted, score = np.array([y for *_, y in seen]), np.array([p for p, *_ in seen]), np.array([s for _, s, _ in seen])
        below = score[y == 0][:, None] < score[y == 1]
        print(label, "held out:", len(y), "accuracy", (y == predicted).mean(), "area", below.mean(), "recall", predicted[y == 1].mean(), "precision", y[predicted == 1].mean())
        assert (y == predicted).mean() > 0.93 and below.mean() > 0.9
        assert predicted[y == 1].mean() > 0.7 and y[predicted == 1].mean() > 0.85


def test_classifiers_on_edges(spark):
    texts = [None, "", "!!! 123", "good words here " * 30, "idiot " * 40, "x" * 300_000, "good words here " * 30]
    docs = documents(spark, texts).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (6, 1, 0), (99, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for table in (labels, labels.limit(0), labels.filter("doc_id = 3")):
            got = module.score(docs, module.fit(docs, table)).collect()
            assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
            assert module.score(docs.limit(0), module.fit(docs, table)).count() == 0
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") == 4, "de").otherwise(F.col("lang"))))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[3].lang_pred == "en" and got[4].lang_pred == "de"
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_toxicity_learns_words(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    make = lambda bad: " ".join(r.choices(words, k=60) + ["scoundrel"] * bad)
    docs = documents(spark, [make(int(i % 4 == 0)) for i in range(400)] + [make(1), make(0), make(1), ""])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    s = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert s[400] > 0.7 and s[402] > 0.7 and s[401] < 0.5 and s[403] < 0.7


def test_toxicity_features_of_characters():
    texts = ["Éa b\n😀c", "", "éa", "x" * 60]
    for step in (1 << 20, 7):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "STEP", step)
            row, slot, value = toxicity.features(*utf8(pa.array(texts)))
        got = [sorted(value[row == i].tolist()) for i in range(4)]
        for i, t in enumerate(texts):
            t = f" {t.lower()} ".replace("\n", " ")
            grams = [t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)]
            want = sorted(np.log1p(toxicity.UNIT * grams.count(g) / max(toxicity.SHORT, len(t))) for g in set(grams))
            assert got[i] == pytest.approx(want)


def test_newton_steps_find_the_minimum():
    a = np.diag([1.0, 10.0, 100.0]) + 0.5
    x = toxicity.minimize(lambda v: (float(0.5 * v @ a @ v - v.sum()), a @ v - 1), np.zeros(3))
    assert x == pytest.approx(np.linalg.solve(a, np.ones(3)), abs=1e-5)
    assert toxicity.best_limit(np.array([3.0, 2.0, 2.0, 1.0, 0.0]), np.array([1.0, 1, 0, 1, 0])) == pytest.approx(0.5)


def test_attention_gradient():
    r = np.random.default_rng(2)
    x, bags, y = r.normal(size=(12, quality.WIDTH)), np.array([3, 1, 5, 3]), np.array([0.0, 1.0, 1.0, 0.0])
    m = quality.AttentionMil(quality.AttentionMil.start(5, 4, 0), np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    first = np.cumsum(bags) - bags
    loss = lambda: float(np.mean(np.log1p(np.exp(m.forward(x, first)[0])) - y * m.forward(x, first)[0]))
    for name, g in m.gradient(x, first, y).items():
        at = tuple(0 for _ in m.p[name].shape)
        m.p[name][at] += 1e-5
        up = loss()
        m.p[name][at] -= 2e-5
        down = loss()
        m.p[name][at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_many_languages(spark):
    r = random.Random(3)
    texts = []
    for k in range(70):  # more than one word of mask bits
        alphabet = r.sample("abcdefghijklmnopqrstuvwxyz", 6)
        texts += [(f"l{k:02}", " ".join("".join(r.choices(alphabet, k=5)) for _ in range(80))) for _ in range(4)]
    docs = documents(spark, [t for _, t in texts]).drop("lang").join(spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(texts)], "doc_id long, lang string"), "doc_id")
    got = langid.identify(docs, langid.fit(docs, min_count=1), keep=("lang",)).collect()
    assert np.mean([x.lang_pred == x.lang for x in got]) > 0.95 and all(0 <= x.score <= 1 for x in got)


def test_a_rare_language_is_learned(spark):
    docs = documents(spark, [f"the cat number {i} sat on a mat" for i in range(3000)] + ["zyx wvu tsr qpo " * 4] * 3)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") >= 3000, "rare").otherwise("en"))
    model = langid.fit(docs, max_texts=100, min_count=2)
    assert langid.identify(docs, model, keep=("lang",)).filter("lang <> lang_pred").count() == 0


# --- urls


def test_urls(spark):
    cases = ["http://A.Example.NET/en/x?q", "http://example.net/fr", "https://net/", "https://net", None, "no scheme", "http://x.org/fr/a#b", "http://notexample.com/de/", "http://example.com/de/", "ftp://a://b/c"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    for limit in (100, 0):  # rules broadcast, and shuffled
        got = {r.page_id: r for r in urls.judge_urls(pages, urls.rules_table(spark, queries.URL_RULES), broadcast_rules=limit).collect()}
        assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
        assert [got[i].rule for i in range(1, 10)] == ["net/", "net/", None, None, None, "org/fr/", None, "example.com/de/", None]
        assert (got[4].host, got[4].path, got[4].verdict) == ("", "", "allow") and got[9].host == "a:"
    deep = spark.createDataFrame([(1, "http://" + "a." * 3000 + "net/x"), (1, "http://" + "a." * 3000 + "net/x"), (None, "http://net")], "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "row", "id", "verdict")})
    assert [(r.rule, r.verdict) for r in urls.judge_urls(deep, urls.rules_table(spark, queries.URL_RULES)).collect() if r.page_id] == [("net/", "block")] * 2
    assert urls.judge_urls(pages, urls.rules_table(spark, queries.URL_RULES).limit(0)).filter("verdict = 'allow'").count() == 10
    assert urls.judge_urls(pages.limit(0), urls.rules_table(spark, queries.URL_RULES)).count() == 0


# --- repeated passages


def brute_runs(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    return gone


def spoiled(seed, n=40):
    r = random.Random(seed)
    base = ["".join(r.choices("ab cdé\x00\n", k=r.randint(0, 900))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = list(r.choice(base)) if r.random() < 0.7 else list("".join(r.choices("abc ", k=500)))
        for _ in range(r.randint(0, 3)):
            if t:
                t[r.randrange(len(t))] = r.choice("xyz")
        out.append("".join(t))
    line = "".join(r.choices("lmnop", k=150))  # common between texts that differ, and where NULs end a text
    ends = ["".join(r.choices("rst", k=r.randint(0, 200))) + line + "\x00" * r.randint(0, 90) for _ in range(25)]
    return [*out, None, "", "a" * 1500, "ab" * 400, base[0], base[0], "q" * 199, *ends, "\x00" * 230, "\x00" * 210]


def test_byte_runs_against_brute_force(spark):
    for seed, length in ((1, 200), (2, 60)):
        texts = spoiled(seed)
        raw = [(t or "").encode() for t in texts]
        gone = brute_runs(raw, length)
        for batches, hot in ((1, 20_000), (4, 2)):  # hot: seeds that are found more often are split
            docs = documents(spark, texts).withColumn("starts", F.lit("clash"))
            got = {r.doc_id: r for r in suffix.remove_runs(docs, length, batches, with_bytes=True, hot_suffixes=hot, chunk_bytes=3000 if hot == 2 else 1 << 20).collect()}
            for d, t in enumerate(raw):
                kept = bytes(c for i, c in enumerate(t) if i not in gone[d])
                spans = sum(i in gone[d] and i - 1 not in gone[d] for i in range(len(t)))
                assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(t), len(gone[d]), spans)
                assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(got[d].kept) == kept
    assert suffix.remove_runs(documents(spark, []), 200).count() == 0


def test_anchors_in_stretches(monkeypatch):
    r = np.random.default_rng(6)
    data, bounds = r.integers(97, 101, 5000).astype(np.uint8), np.array([0, 300, 300, 450, 4800, 5000])
    want = suffix.anchors(data, bounds, 200)
    monkeypatch.setattr(suffix, "STEP", 700)
    got = suffix.anchors(data, bounds, 200)
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(want[0]) > 20


def test_suffixes_that_end_in_nul():
    texts = [b"s" * 40 + t for t in (b"\0\0b" + b"x" * 60, b"\0", b"\0\0b" + b"x" * 60, b"", b"\0\0")]
    right = np.array([np.frombuffer(t.ljust(110, b"\0"), np.uint8) for t in texts])
    family = suffix.SuffixFamily(right, np.array([len(t) for t in texts]), np.zeros((5, 10), np.uint8), np.zeros(5, int))
    assert np.argsort(family.text, kind="stable").tolist() == [3, 1, 4, 0, 2]


def test_suffix_family_large_classes():
    r = random.Random(5)
    seed = "".join(r.choices("abcdefgh", k=40))
    texts = [("".join(r.choices("ab", k=3)) * 20 + seed + "".join(r.choices("ab", k=2)) * 40).encode() for _ in range(80)]
    wide = [(t[60:260], t[:60][::-1]) for t in texts]
    right = np.array([np.frombuffer(a.ljust(100, b"\0")[:100], np.uint8) for a, _ in wide])
    left = np.array([np.frombuffer(b, np.uint8) for _, b in wide])
    n, m = np.full(80, 100), np.full(80, 60)
    family = suffix.SuffixFamily(right, n, left, m)
    for k in range(5):
        family.add(np.arange(k, 80, 5))
    assert sum(len(v) for v in family.levels.values()) == 80 and set(family.levels) == {0, 2}
    for i, (a, b) in enumerate(wide):
        ok = [d for d in range(61) if any(j != i and wide[j][0][: 100 - d] == a[: 100 - d] and wide[j][1][:d] == b[:d] for j in range(80))]
        assert (family.least[i], family.most[i]) == ((ok[0], ok[-1]) if ok else (61, -1))


def brute_windows(rows, window):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


def test_windows_against_brute_force(spark):
    r = random.Random(7)
    passage = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        words = [r.choice("abcd") + str(r.randint(0, 9)) for _ in range(r.randint(0, 80))]
        at = r.randint(0, len(words))
        if r.random() < 0.6:
            s = r.randint(0, 30)
            words[at:at] = passage[s : s + r.randint(40, 60)]
        rows.append((r.randint(0, 40), r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(50, None), (51, ""), (52, rows[0][1]), (52, rows[0][1]), (53, "é\u00a0ü " * 200)]
    for chunk in (500, 1 << 22):
        docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
        out = substring.remove_repeats(docs, 20, with_text=True)
        spans = substring.repeated_windows(docs, 20, chunk_bytes=chunk)
        assert spans.count() > 0
        got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in out.collect())
        assert got == sorted((i, *b) for (i, _), b in zip(rows, brute_windows(rows, 20), strict=True))
    for x in out.collect():
        assert x.kept_text is None or hashlib.sha256(b" ".join(x.kept_text.encode().split())).hexdigest() == x.kept_sha256
    assert substring.remove_repeats(documents(spark, []), 20).count() == 0


# --- near duplicates


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, n=120):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 300)}" for _ in range(120)] for _ in range(5)]
    texts = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 6, 10])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
        texts.append(" ".join(w))
    return [*texts, None, "", "one", "ONE", "one two", " \n", *texts[:3]]


@pytest.mark.parametrize("limit", [1000, 25, 4])
def test_near_duplicates_against_brute_force(spark, limit):
    texts = near_copies(limit)
    docs = documents(spark, texts).withColumns({"n": F.lit("clash"), "text_hash": F.lit("clash"), "component_id": F.lit("clash")})
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 3, 85, group_nodes=limit).collect()}
    for i, (n, root) in enumerate(brute_components(texts, 3, 85)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, i == root)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1000, 3])
def test_near_duplicates_in_mixed_buckets(spark, limit):
    """With one band of one coordinate, buckets hold several components and all pairs in one are compared."""
    r = random.Random(21)
    texts = []
    for _ in range(25):
        base = [f"w{r.randint(0, 12)}" for _ in range(40)]
        for _ in range(r.randint(1, 5)):
            w = list(base)
            w[r.randrange(40)] = f"x{r.randint(0, 3)}"
            texts.append(" ".join(w))
    bands = 60  # of one coordinate: pairs at the threshold are missed with probability 1e-48
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(spark, texts), 3, 80, bands, 1, group_nodes=limit).collect()}
    assert [got[i] for i in range(len(texts))] == [root for _, root in brute_components(texts, 3, 80)]


def test_near_duplicates_of_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(None, long), (5, long + " end"), (3, "short text here"), (None, "only one without a name"), (None, "only one without a name")]
    got = sorted(tuple(r)[:4] for r in minhash.near_duplicates(documents(spark, [t for _, t in rows], [i for i, _ in rows]), group_shingles=1000).na.fill(-1).collect())
    assert got == [(-1, 3, -1, True), (-1, 3, -1, True), (-1, 119_998, 5, False), (3, 1, 3, True), (5, 119_999, 5, True)]


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    pairs += [(5000, i) for i in range(5001, 5200)] + [(i, 6000) for i in range(5800, 6000)]  # more links than a shuffled key may have
    odd = [(7, None), (None, None), (9, 9), pairs[0], pairs[0]]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs + odd, "a long, b long")).collect()}
    assert connected_components(spark.createDataFrame(odd[:3], "a long, b long")).count() == 0
    want = {}
    for a, b in pairs:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(100):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


# --- benchmark passages


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_and_search():
    r = random.Random(11)
    items = [(k, "".join(r.choices("abcd ", k=r.randint(25, 90))).strip()) for k in range(12)]
    index = decontaminate.ItemIndex([(k, decontaminate.normalize(s.encode())) for k, s in items], 0.1)
    for _ in range(150):
        k, s = r.choice(items)
        t = list(s)
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(t))
            r.choice([lambda: t.insert(at, "z"), lambda: t.pop(at), lambda: t.__setitem__(at, "y")])()
        text = decontaminate.normalize(("".join(r.choices("abcd ", k=40)) + "".join(t) + "".join(r.choices("abcd ", k=40))).encode())
        want = {(i, d, b) for i, s2, b in index.items if (d := edit_distance(s2, text)) <= b}
        assert set(index.search(text)) == want


def test_contaminations(spark):
    item = "The quick brown fox jumps over the lazy dog, and then sleeps until noon."
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "tiny"), (4, "Été à Évreux: où l'âne s'égare près du pré vert"), (None, item), (6, "!?"), (7, "")], "item_id long, text string")
    texts = [f"aa {item.upper()} bb", item.replace(",", ";\n"), item.replace("brown", "brwn"), "clean text " * 50, None, "", "x " * 100_000 + item, "ÉTÉ À ÉVREUX — OÙ L'ÂNE S'ÉGARE PRÈS DU PRÉ VERT", "not tinyer", "a (Tiny) one", "Tiny", item]
    docs = documents(spark, texts, [*range(11), 0]).withColumns({c: F.lit("clash") for c in ("matches", "found", "key", "text_", "item_id")})
    want = sorted([(0, 1, 0), (0, 1, 0), (1, 1, 0), (2, 1, 1), (6, 1, 0), (0, -1, 0), (0, -1, 0), (1, -1, 0), (2, -1, 1), (6, -1, 0), (7, 4, 0), (9, 3, 0), (10, 3, 0)])
    for block in (8 << 20, 60):
        got = decontaminate.contaminations(docs, bench, block_bytes=block).na.fill(-1, ["item_id"]).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == want
        for keep in (("doc_id", "text"), ("doc_id", "key", "found")):
            found = decontaminate.find_items(docs, bench, block_bytes=block, keep=keep, column="hits").collect()
            assert len(found) == len(texts) and sorted((r.doc_id, -1 if m.item_id is None else m.item_id, m.distance) for r in found for m in r.hits) == want
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminations(docs.limit(0), bench).count() == 0


# --- tokens


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = bpe.load(path, public_tokenizers.PATTERN)[0]
    assert isinstance(encoding, tiktoken.Encoding)
    r = random.Random(13)
    texts = [None, "", "<|endoftext|> Hello  world\n\n  x", "".join(r.choices("ab é\n\t 1.'s😀", k=200_000)), "word " * 40_000, "z" * 50_000, " " * 3000]
    got = {x.doc_id: x for x in bpe.encode_decode(documents(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].round_trip
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert "".join(bpe.pieces(texts[3], 1000)) == texts[3]
    assert bpe.encode_decode(documents(spark, []), path, public_tokenizers.PATTERN).count() == 0


# --- pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    r = random.Random(17)
    prose = [" ".join("".join(r.choices("etaoinshr", k=r.randint(2, 8))) for _ in range(150)) for _ in range(6)]
    shared = " ".join(prose[5].split()[:60])
    near = prose[0].split()
    near[70] = "changed"
    texts = [prose[0], " ".join(near), prose[0], prose[1], f"{prose[2]}\n{shared}", f"{prose[3]} {shared}", f"{prose[4]} {item}", "123 !!!", None, ""]
    docs, kept = documents(spark, texts), []
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_substrings", "decontamination", "tokens"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({x.doc_id for x in docs.collect()})
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "repeated_substrings":
            by = {x.doc_id: x for x in docs.collect()}
            assert by[4].text == texts[4] and by[5].text == prose[3] and by[5].n_chars == len(prose[3])
    assert kept == [set(range(7)), {0, 3, 4, 5, 6}, {0, 3, 4, 5, 6}, {0, 3, 4, 5}, {0, 3, 4, 5}]
    assert docs.filter("not round_trip").count() == 0 and docs.agg(F.min("n_tokens")).first()[0] > 0


def test_pipeline_on_edges(spark, sf_dir, tmp_path):
    text = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(None, None), (None, "no name here"), (None, "no name here"), (4, ""), (4, "four letters"), (4, "four letters"), (5, text), (6, text + " end"), (7, "one two"), (7, "eins zwei drei")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({c: F.lit("clash") for c in ("lang_pred", "component_id", "matches", "n_tokens", "__hash")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), sf_dir).count() == 0
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = sorted((r.doc_id or -1, r.n_tokens > 0) for r in docs.collect())
    assert got == [(-1, True), (4, True), (5, True), (7, True), (7, True)] and docs.filter("not round_trip").count() == 0


def test_pipeline_deletes_its_scratch(spark, sf_dir):
    before = set(common._written)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and len(set(common._written) - before) == 1
