"""Ranked lexical search over sharded inverted indexes, by Block-Max MaxScore.

1. Index: tasks cut the documents into shards of bounded size. A shard has a list of postings for every term: its documents
   in the order of their ids and how often each holds the term, in compressed blocks of ``BLOCK`` postings. With each block go
   its first and last document and its best (frequency, document length) pairs, from which the largest contribution of the
   block follows once the whole corpus' statistics are known, without decompressing it.
2. Statistics: documents, terms, and the documents of each term asked for, summed over all shards.
3. Search: the terms of all items meet the lists by term; a task has one shard's lists for a group of items. For each item, its
   lists are taken by falling bound (the largest contribution anywhere in the list). As long as the bounds of the lists not yet
   taken could lift a document without any earlier term into the shard's best ``k``, the next list is essential and is added up
   whole. From then on only documents seen so far count: for each further list they are dropped if even the maximum
   of the block that could hold them, with the bounds of the rest, leaves them below the k-th best; only blocks with
   documents that are left are decompressed.
4. The best of each shard are merged to the best of all.

Weights and scores: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), with N documents that have a term and df that have this
one. A document of n terms has m = 25 + 75 n N div L, where L counts the terms of all documents. A term found tf times adds weight * (10**9 tf div
(1000 tf + 8 m)), for each time that the item names it. Terms are runs of ASCII letters and digits and of characters beyond
ASCII; A-Z count as a-z.

Cases: null and empty texts have no terms, are in no list and do not count in N. Documents of equal score come by id, null ids last.
Each row is a document of its own, also where rows repeat. Equal items are one; items with one id and different texts are ranked
each, with null ids too. An item without a term that any document holds has no rows. Texts are read as bytes, valid UTF-8 or not.
A very long text is a shard of its own. Empty tables give no rows. Columns other than the ids and texts are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import ASCII_LOWER, distinct_slices, gather, materialize, utf8, words
from .substring import NULL_ID, chunks, keyed

#: Bytes of text of a shard, about; postings of a block; items of a group.
SHARD_BYTES = 6 << 20
BLOCK = 128
GROUP_ITEMS = 2000
#: Terms asked for, with the items that ask, are broadcast to the index if they are no larger.
BROADCAST_BYTES = 32 << 20
#: Bytes that end terms.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: A shard's own row has no term, the documents' ids in ``data`` and their numbers of terms in ``best``. A list has ``blocks``: four numbers a block (first and
#: last document, where its bytes begin, and postings | bytes a document << 16 | bytes a frequency << 24); ``best``: three a pair (block, frequency, terms of
#: the shortest document with it); ``data``: each block's documents less its first, then its frequencies.
INDEX = "shard long, term binary, df int, terms long, blocks binary, best binary, data binary"


def index_shard(number: int, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``INDEX`` for the documents of one shard, which are sorted by id."""
    data = ASCII_LOWER[data]
    start, end, first = words(data, bounds, BREAKS)
    length = np.diff(first)
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    own = [number, None, int((length > 0).sum()), int(length.sum()), None, length.astype(np.uint32).tobytes(), ids.tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(own, kinds, strict=True)], names=names)
    if not len(start):
        return
    like, of = distinct_slices(data, start, end)
    key, tf = np.unique(of * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
    term, doc = key // len(length), key % len(length)
    lists = np.searchsorted(term, np.arange(len(like) + 1))
    df = np.diff(lists)
    at = np.arange(len(term)) - np.repeat(lists[:-1], df)
    begin = np.flatnonzero(at % BLOCK == 0)
    size = np.diff(np.append(begin, len(term)))
    block = np.repeat(np.arange(len(begin)), size)
    last = begin + size - 1
    away = doc - np.repeat(doc[begin], size)
    doc_bytes, tf_bytes = (np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4)) for top in (np.maximum.reduceat(away, begin), np.maximum.reduceat(tf, begin)))
    block_bytes = size * (doc_bytes + tf_bytes)
    offset = np.append(0, np.cumsum(block_bytes))
    raw = np.zeros(offset[-1], np.uint8)
    inside = np.arange(len(term)) - np.repeat(begin, size)
    for values, width, base in ((away, doc_bytes, offset[:-1]), (tf, tf_bytes, offset[:-1] + size * doc_bytes)):
        place = np.repeat(base, size) + inside * np.repeat(width, size)
        for b in range(4):
            wide = np.repeat(width > b, size)
            raw[place[wide] + b] = (values[wide] >> (8 * b)) & 255
    of_list = np.repeat(np.arange(len(df)), -(-df // BLOCK))
    blocks_of = np.searchsorted(of_list, np.arange(len(df) + 1))
    list_offset = offset[blocks_of]
    head = np.stack([doc[begin], doc[last], offset[:-1] - list_offset[of_list], size | doc_bytes << 16 | tf_bytes << 24], 1).astype(np.uint32)
    # of each block, by falling frequency, the pairs with shorter documents than all of higher frequency
    terms = length[doc]
    order = np.lexsort((terms, -tf, block))
    low = np.minimum.accumulate(terms[order] - block[order] * (int(length.max()) + 1))
    best = order[np.append(True, low[1:] < low[:-1])]
    pairs = np.stack([block[best] - blocks_of[of_list[block[best]]], tf[best], terms[best]], 1).astype(np.uint32)
    pair_of = np.searchsorted(block[best], blocks_of)
    name_bytes = end[like] - start[like]
    columns = [(np.append(0, np.cumsum(name_bytes)), data[gather(start[like], name_bytes)]), (16 * blocks_of, head), (12 * pair_of, pairs), (list_offset, raw)]
    for i in range(0, len(df), 50_000):
        j = min(i + 50_000, len(df))
        blobs = [_binary(cut[i : j + 1], values) for cut, values in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, number)), blobs[0], pa.array(df[i:j], pa.int32()), pa.nulls(j - i, pa.int64()), *blobs[1:]], names=names)


def _binary(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values that lie one after another."""
    raw = values.reshape(-1).view(np.uint8)[cut[0] : cut[-1]]
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A table of ``INDEX`` rows over all documents, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, _, data, bounds in chunks(batches, shard_bytes):
            yield from index_shard(number, ids, data, bounds)

    rows = keyed(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col).filter(F.octet_length(text_col) > 0)
    return materialize(rows.select("__id", "__hash", text_col).mapInArrow(run, INDEX), "lexical-index")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_hash, term, times) of each different item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(2))
            data = ASCII_LOWER[data]
            start, end, first = words(data, bounds, BREAKS)
            like, of = distinct_slices(data, start, end)
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            key, times = np.unique(row * max(1, len(like)) + of, return_counts=True)
            row, term = pa.array(key // max(1, len(like))), like[key % max(1, len(like))] if len(key) else key
            terms = [data[s:e].tobytes() for s, e in zip(start[term].tolist(), end[term].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(terms, pa.binary()), pa.array(times)], names=["item_id", "item_hash", "term", "times"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.xxhash64(text_col).alias("item_hash"), F.col(text_col).alias("text")).dropDuplicates()
    return rows.mapInArrow(run, f"item_id {kind}, item_hash long, term binary, times long")


class Postings:
    """One list of a shard."""

    def __init__(self, blocks: bytes, best: bytes, data: bytes, weight: int, gain):
        head = np.frombuffer(blocks, np.uint32).reshape(-1, 4).astype(np.int64)
        self.first, self.last, self.offset, self.shape = head.T
        pair = np.frombuffer(best, np.uint32).reshape(-1, 3).astype(np.int64)
        begin = np.searchsorted(pair[:, 0], np.arange(len(head)))
        self.weight, self.gain, self.data = weight, gain, data
        #: Largest contribution in each block and in all.
        self.block_top = weight * np.maximum.reduceat(gain.of_lengths(pair[:, 1], pair[:, 2]), begin)
        self.top = int(self.block_top.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, contributions) of a block, decompressed once."""
        if b not in self.known:
            shape, at = int(self.shape[b]), int(self.offset[b])
            size, doc_bytes, tf_bytes = shape & 0xFFFF, shape >> 16 & 0xFF, shape >> 24
            docs = np.frombuffer(self.data, f"<u{doc_bytes}", size, at) + self.first[b]
            tf = np.frombuffer(self.data, f"<u{tf_bytes}", size, at + size * doc_bytes).astype(np.int64)
            self.known[b] = docs, self.weight * self.gain(tf, docs)
        return self.known[b]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            parts = [self.block(b) for b in range(len(self.first))]
            self.whole = parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        return self.whole


class Gain:
    """Contribution of a term of weight 1."""

    def __init__(self, length: np.ndarray, documents: int, terms: int):
        self.documents, self.terms = documents, max(1, terms)
        self.m = self.spread(length)

    def spread(self, length: np.ndarray) -> np.ndarray:
        return 25 + 75 * length * self.documents // self.terms

    def __call__(self, tf: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs])

    def of_lengths(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * self.spread(length))


def best_documents(asked: list[tuple[Postings, int]], k: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best by the lists and how often each counts. ``total``: zeros for each document, given back as such."""
    asked = sorted(asked, key=lambda p: -p[0].top * p[1])
    rest = np.append(np.cumsum([p.top * n for p, n in asked][::-1])[::-1], 0)
    seen: list[np.ndarray] = []
    least, at = 1, 0  # scores below ``least`` are of no use
    while at < len(asked) and rest[at] >= least:  # essential lists
        docs, gain = asked[at][0].all()
        total[docs] += gain * asked[at][1]
        seen.append(docs)
        at += 1
        if sum(map(len, seen)) >= k and (at == len(asked) or int(total[docs].max(initial=0)) > rest[at]):
            least = max(least, _kth(total, seen, k))
    docs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
    score = total[docs]
    total[docs] = 0
    for j in range(at, len(asked)):
        postings, times = asked[j]
        block = np.searchsorted(postings.first, docs, "right") - 1
        inside = (block >= 0) & (docs <= postings.last[block])
        stay = score + np.where(inside, postings.block_top[block] * times, 0) + rest[j + 1] >= least
        docs, score, block, inside = docs[stay], score[stay], block[stay], inside[stay]
        for b in np.unique(block[inside]).tolist():
            there, gain = postings.block(b)
            mine = np.flatnonzero(inside & (block == b))
            place = np.minimum(np.searchsorted(there, docs[mine]), len(there) - 1)
            score[mine] += np.where(there[place] == docs[mine], gain[place], 0) * times
        if len(score) >= k:
            least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
    stay = np.flatnonzero(score >= least)
    stay = stay[np.lexsort((docs[stay], -score[stay]))[:k]]
    return docs[stay], score[stay]


def _kth(total: np.ndarray, seen: list[np.ndarray], k: int) -> int:
    """The k-th largest total so far."""
    docs = np.unique(np.concatenate(seen))
    return int(np.partition(total[docs], len(docs) - k)[len(docs) - k]) if len(docs) >= k else 0


def _search(k: int, documents: int, terms: int, kind: pa.DataType):
    def run(group: pa.Table) -> pa.Table:
        """One shard and a group of items."""
        rows = group.drop_columns(["shard", "group"]).to_pylist()
        out = []
        own = [r for r in rows if r["asks"] is None]
        if own:
            ids = np.frombuffer(own[0]["data"], np.int64)
            gain = Gain(np.frombuffer(own[0]["best"], np.uint32).astype(np.int64), documents, terms)
            items: dict[tuple, list[tuple[Postings, int]]] = {}
            for r in rows:
                if r["asks"] is not None and r["weight"] > 0:
                    postings = Postings(r["blocks"], r["best"], r["data"], r["weight"], gain)
                    for a in r["asks"]:
                        items.setdefault((a["item_id"], a["item_hash"]), []).append((postings, a["times"]))
            total = np.zeros(len(ids), np.int64)
            for (item, item_hash), asked in items.items():
                docs, score = best_documents(asked, k, total)
                out += [(item, item_hash, None if i == NULL_ID else i, s) for i, s in zip(ids[docs].tolist(), score.tolist(), strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, [kind, *[pa.int64()] * 3], strict=True)], names=["item_id", "item_hash", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None, shard_bytes: int = SHARD_BYTES, group_items: int = GROUP_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item. ``index``: one of ``build_index`` over ``docs``, to search again."""
    index = build_index(docs, id_col, text_col, shard_bytes) if index is None else index
    whole = index.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("documents"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    asked = materialize(item_terms(items, item_id, item_text), "item-terms")
    n_items = asked.select("item_id", "item_hash").distinct().count()
    groups = max(1, -(-n_items // group_items))
    asks = asked.groupBy("term", F.pmod(F.xxhash64("item_id", "item_hash"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("item_id", "item_hash", "times")).alias("asks"))
    asks = materialize(asks, "asks")
    size = asks.agg(F.coalesce(F.sum(F.octet_length("term") + 64 + 40 * F.size("asks")), F.lit(0))).first()[0]
    known = asks.select("term").distinct()
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * whole["documents"] + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weights = index.filter("term is not null").select("term", "df").join(small(known), "term").groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    asks = asks.join(weights, "term")
    lists = index.filter("term is not null").select("shard", "term", "blocks", "best", "data").join(small(asks), "term")
    none = lambda c: F.lit(None).cast(lists.schema[c].dataType).alias(c)
    own = index.filter("term is null").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), none("blocks"), "best", "data", none("weight"), none("asks"))
    kind = items.schema[item_id].dataType
    found = lists.select(*own.columns).unionByName(own).groupBy("shard", "group").applyInArrow(_search(k, whole["documents"], whole["terms"], to_arrow_type(kind)), f"item_id {kind.simpleString()}, item_hash long, doc_id long, score long")
    order = Window.partitionBy("item_id", "item_hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", F.col("doc_id").alias(id_col), "score")
