"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: a passage within k edits contains
at least one piece unchanged. One pass of an Aho-Corasick automaton over each document finds all pieces;
every region around a hit is then verified by Myers' bit-parallel edit distance against the whole item.

Both sides are normalised: lower-cased, every run of characters other than letters and digits one blank. Edits count in bytes of that text. The budget is ``rate`` times the item's length.

Items of fewer than ``min_bytes`` normalised bytes have no budget and are matched as whole words.

Items are made distinct and come to the driver as a stream that is cut into blocks of at most ``block_bytes`` (an item
that is longer is a block alone). Each block is one pass over the documents, whose matches are written before the
block is given up, so that neither the driver nor a task holds more than one. No text is shuffled, unless
matches of several blocks have to be put beside their documents again.

Cases: null and empty texts match nothing, nor do items that are null or hold no letter or digit. Repeated documents are
each reported, repeated items (of equal id and text) once; items of equal text but other ids each; null ids as others. An
id with several texts is several items. Very long texts are matched whole. In texts that are not valid UTF-8, what is
wrong counts as a blank. Empty tables give empty results. Columns not in
``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, utf8

_NORMAL = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _NORMAL[_b] = ord(_c.lower()) if _c.isalnum() else 32
_NORMAL = bytes(_NORMAL)
_OTHER = re.compile(r"[\W_]+")


def normalize(text: bytes) -> str:
    """The normalised bytes, one character each."""
    if not text.isascii():
        return _OTHER.sub(" ", text.decode(errors="replace").lower()).strip().encode().decode("latin-1")
    return b" ".join(text.translate(_NORMAL).split()).decode("latin-1")


def split_item(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(item: str, text: str, at_most: int) -> int:
    """Smallest edit distance between ``item`` and any substring of ``text``; at_most + 1 if it is larger."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return min(best, at_most + 1)


class ItemIndex:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], rate: float, min_bytes: int = 0):
        import ahocorasick

        # short items: between blanks; all texts are searched with a blank at both ends
        self.items = [(i, f" {s} ", 0) if len(s) < min_bytes else (i, s, int(rate * len(s))) for i, s in items if s]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, s, budget) in enumerate(self.items):
            for at, piece in split_item(s, budget):
                pieces.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int]]:
        """(item id, distance, budget) of every item within its budget somewhere in the normalised ``text``."""
        if not len(self.automaton):
            return []
        text = f" {text} "
        starts: dict[int, set[int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for k, at in owners:
                starts.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k, places in sorted(starts.items()):
            item_id, item, budget = self.items[k]
            best, lo, hi = budget + 1, 0, -1
            for s in [*sorted(places), None]:
                if s is not None and hi >= 0 and s - budget <= hi:
                    hi = s + len(item) + budget
                    continue
                if hi >= 0 and best:
                    best = min(best, myers(item, text[max(0, lo) : hi], budget))
                if s is not None:
                    lo, hi = s - budget, s + len(item) + budget
            if best <= budget:
                out.append((item_id, best, budget))
        return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The distinct items, normalised, in blocks."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(item_id, F.make_valid_utf8(F.col(item_text))).distinct()
    block, size = [], 0
    for i, text in items.toLocalIterator():
        text = normalize(text.encode())
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    yield block


def _found_type(benchmark: DataFrame, item_id: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("distance", T.IntegerType()), T.StructField("budget", T.IntegerType())]))


def _match(docs: DataFrame, text_col: str, items: list[tuple[object, str]], rate: float, min_bytes: int, found_type: T.ArrayType, name: str, drop_text: bool) -> DataFrame:
    """``docs`` (without ``text_col`` if so asked) and the matches of one block of items in it."""
    at, block = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(items)
    kept = [k for k in range(len(docs.columns)) if not (drop_text and k == at)]
    schema = T.StructType([*[docs.schema.fields[k] for k in kept], T.StructField(name, found_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(found_type)
        index = ItemIndex(block.value, rate, min_bytes)
        for b in batches:
            data, bounds = utf8(b.column(at))
            raw = memoryview(data)
            found = [[{"item_id": i, "distance": d, "budget": k} for i, d, k in index.search(normalize(bytes(raw[s:e])))] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array(found, kind)], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _fresh(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.05, min_bytes: int = 20, block_bytes: int = 2 << 20, keep: tuple[str, ...] = ("doc_id",), column: str = "matches") -> DataFrame:
    """The columns in ``keep`` of every row of ``docs`` and ``column``: array of (item_id, distance, budget)."""
    found_type, options = _found_type(benchmark, item_id), (rate, min_bytes)
    name = text_col if text_col in keep else _fresh(text_col, list(keep))
    source = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias(name))
    passes = _blocks(benchmark, item_id, item_text, block_bytes)
    items, rest = next(passes), next(passes, None)
    if rest is None:
        return _match(source, name, items, *options, found_type, column, text_col not in keep)
    parts = []
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    while items is not None:  # what matches is found by text, so copies of a text are searched together
        hits = _match(texts.select(F.md5("text").alias("key"), "text"), "text", items, *options, found_type, "found", True).filter(F.size("found") > 0)
        parts.append(materialize(hits.dropDuplicates(["key"]), "item-matches"))
        items, rest = rest, next(passes, None)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("found")).alias(_fresh(column, source.columns)))
    key = _fresh("key", [*source.columns, *found.columns])
    out = source.withColumn(key, F.md5(name)).join(found.withColumnRenamed("key", key), key, "left")
    return out.select(*keep, F.coalesce(found.columns[1], F.array().cast(found_type)).alias(column))


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.05, min_bytes: int = 20, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document and item found in it: id, item_id, distance, budget."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    passes = _blocks(benchmark, item_id, item_text, block_bytes)
    items, rest, out = next(passes), next(passes, None), None
    several = rest is not None
    while items is not None:
        hits = _match(source, "text", items, rate, min_bytes, _found_type(benchmark, item_id), "found", True)
        hits = hits.select("id", F.explode("found").alias("m")).select(F.col("id").alias(id_col), "m.item_id", "m.distance", "m.budget")
        hits = materialize(hits, "item-matches") if several else hits
        out = hits if out is None else out.union(hits)
        items, rest = rest, next(passes, None)
    return out
