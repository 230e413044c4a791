"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the frequent byte n-grams of every language: slot s is a mask with one bit
per language, so that one lookup (the AND of a few slots) returns all languages containing an n-gram. A
document's n-grams are looked up, the hits of each language counted, and the counts corrected for the
filter's false positives, which differ by language; the largest corrected count decides.

Learning: a bounded sample of labelled texts (``max_texts``, ``max_bytes``, in equal shares by language; see
``bounded_rows``) gives n-gram rates per language, counted in Spark. An n-gram enters a language's slice if its rate
there is at least ``share`` of its largest rate and it occurs ``min_count`` times; only these n-grams come to the
driver. The commonest ``max_languages`` languages are learned; masks have as many 64-bit words as needed. The
filter's size depends on the sample alone.

Cases: null text or text without a letter gives ``und`` with score 0. A text whose n-grams are in no
filter gets the language with most labelled texts and score 0. Ties go to the language first by name. An
empty sample predicts ``und`` throughout. Repeated rows and null ids are judged one by one. An empty table gives no
rows. Columns not in ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, blocks, bounded_rows, discard, materialize, mix64, utf8

UNKNOWN = "und"
SIZES = (3, 5)
HASHES = 2


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram (up to 8 bytes) that starts at each byte, as one integer with its length."""
    m = max(0, len(data) - n + 1)
    x = np.full(m, n, np.uint64)
    for i in range(n):
        x = (x << np.uint64(8)) | data[i : i + m]
    return x


def slots(x: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(x)
    return [((h >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilter:
    """languages: bit i of word i // 64 is languages[i]; table: words x slots; false_rate: by language, per size."""

    languages: list[str]
    bits: int
    table: np.ndarray
    false_rate: np.ndarray
    fallback: int

    @staticmethod
    def build(languages: list[str], chosen: dict[str, np.ndarray], common: str | None, load: float) -> LanguageFilter:
        """chosen: the n-grams of each language; common: the language of texts without a hit."""
        most = max([1, *(len(g) for g in chosen.values())])
        bits = int(np.clip(np.ceil(np.log2(most * HASHES / load)), 12, 26))
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64)
        for i, lang in enumerate(languages):
            for s in slots(chosen.get(lang, np.zeros(0, np.uint64)), bits):
                np.bitwise_or.at(table[i // 64], s, np.uint64(1 << (i % 64)))
        fill = np.array([((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= 8 * np.dtype(t).itemsize or t is np.uint64)
        return LanguageFilter(languages, bits, table.astype(kind), fill**HASHES, languages.index(common) if languages else -1)

    def count(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits (rows x languages) and n-grams of each row, over whole texts."""
        rows = len(bounds) - 1
        hits, total = np.zeros((rows, len(self.languages))), np.zeros(rows)
        data = ASCII_LOWER[data]
        for n in SIZES:
            x = grams(data, n)
            lo, hi = np.minimum(bounds[:-1], len(x)), np.clip(bounds[1:] - n + 1, 0, len(x))
            hi = np.maximum(hi, lo)
            at = slots(x, self.bits)
            for w in range(len(self.table)):
                mask = self.table[w][at[0]]
                for s in at[1:]:
                    mask &= self.table[w][s]
                for i in range(64 * w, min(len(self.languages), 64 * w + 64)):
                    seen = np.zeros(len(x) + 1, np.int64)
                    np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), out=seen[1:])
                    hits[:, i] += seen[hi] - seen[lo]
            total += hi - lo
        return np.maximum(0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)), total

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score): the score is the winner's share of all languages' corrected hits."""
        hits, _ = self.count(data, bounds)
        all_hits = hits.sum(1)
        found = all_hits > 0
        best = np.where(found, hits.argmax(1), self.fallback)
        return best, np.where(found, hits.max(1, initial=0) / np.where(found, all_hits, 1), 0.0)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, text) -> n-grams of each language with their counts within the batch."""
    for b in batches:
        names = b.column(0).dictionary_encode()
        number, lang_names = names.indices.to_numpy(), names.dictionary
        for k in range(len(lang_names)):
            data, bounds = utf8(b.column(1).take(pa.array(np.flatnonzero(number == k))))
            data = ASCII_LOWER[data]
            for n in SIZES:
                row = np.searchsorted(bounds, np.arange(max(0, len(data) - n + 1)), "right") - 1
                x, c = np.unique(grams(data, n)[np.arange(len(row)) + n <= bounds[row + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(np.full(len(x), k))), pa.array(np.full(len(x), n, np.int32)), pa.array(x.astype(np.int64)), pa.array(c)], names=["lang", "n", "gram", "c"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_texts: int = 6000, max_bytes: int = 32 << 20, max_languages: int = 256, share: float = 0.4, min_count: int = 3, load: float = 0.02) -> LanguageFilter:
    """Fit on a bounded sample of the rows with text and language."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sample = bounded_rows(rows, max_texts, "text", max_bytes, "lang", max_languages)
    counted = sample.select("lang", "text").mapInArrow(count_grams, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counted = materialize(counted, "language-grams")
    rate = counted.join(F.broadcast(counted.groupBy("lang", "n").agg(F.sum("c").alias("total"))), ["lang", "n"]).withColumn("rate", F.col("c") / F.col("total"))
    best = rate.groupBy("n", "gram").agg(F.max("rate").alias("best"))
    found = rate.join(best, ["n", "gram"]).filter((F.col("c") >= min_count) & (F.col("rate") >= share * F.col("best"))).select("lang", "gram").toArrow()
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    common = rows.filter(F.col("lang").isin(languages)).groupBy("lang").count().orderBy(F.desc("count"), "lang").first()
    discard(counted)
    lang, gram = found.column("lang").to_numpy(), found.column("gram").to_numpy().astype(np.uint64)
    return LanguageFilter.build(languages, {x: gram[lang == x] for x in languages}, common and common["lang"], load)


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred and score to the id and the columns in ``keep`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *[c for c in keep if c not in (id_col, text_col)]]
    carry = text_col in keep
    source = docs.select(*names, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"), text_col)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in [*names, *[text_col] * carry]) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, bounds = utf8(b.column(b.num_columns - 1))
            letters = b.column(b.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            if m.languages:
                for i, j in blocks(bounds):
                    best[i:j], score[i:j] = m.predict(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            best[~letters], score[~letters] = -1, 0
            named = pa.array([*m.languages, UNKNOWN]).take(pa.array(np.where(best < 0, len(m.languages), best)))
            columns = [*b.columns[: len(names)], *[b.column(b.num_columns - 1)] * carry, named, pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[text_col] * carry, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
