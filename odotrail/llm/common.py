"""Helpers shared by the training-data operators.

Text is handled inside tasks as the UTF-8 bytes of Arrow string columns, without making a Python
string for every row. A null text counts as an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import scratch_root

#: Bytes of text that one numpy step works on; a single longer text is worked on alone.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables written by ``materialize`` in this process and not yet deleted.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.
    The table stays until ``discard`` or the end of a ``scratch_tables`` block deletes it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/odotrail/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._odotrail_path = path
    _written[path] = spark
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later step reads; does nothing for other tables."""
    _delete(getattr(df, "_odotrail_path", None))


def _delete(path: str | None) -> None:
    spark = _written.pop(path, None)
    if spark is not None:  # Hadoop's file system knows every scheme that Spark can write
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def scratch_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at the end what ``materialize`` wrote within the block, save tables passed to the function it yields.
    Operators return DataFrames that still read their scratch tables, so write a result out within the block."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_odotrail_path", None))
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _written if p not in before and p not in kept]:
            _delete(path)


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About ``n`` rows (all, if there are fewer): those whose hash of ``keys`` is below a threshold set from
    the row count. Repeatable whatever the partitioning, and without sorting or moving rows."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < F.lit(int((1 << 40) * n / total)))


def bounded_rows(df: DataFrame, n: int, text_col: str, max_bytes: int = 64 << 20, by: str | None = None, max_groups: int = 256) -> DataFrame:
    """A sample to fit on: at most ``n`` rows with at most ``max_bytes`` bytes of text, whatever ids or values repeat.

    Rows are taken by the least hash of the whole row, equal rows counting once; a row of more than a 64th of
    ``max_bytes`` is never taken. With ``by``, each of its values (the ``max_groups`` commonest; null is none) has
    an equal share of both bounds, so that a rare value is not crowded out. All rows that may be taken come back, as
    often as they are, if they are within the bounds. Repeatable whatever the partitioning; only hashes and sizes of at most
    ``n`` rows reach the driver."""
    size, group = F.coalesce(F.octet_length(text_col), F.lit(0)), F.lit("") if by is None else F.col(by).cast("string")
    hashed = df.withColumns({"__hash": F.xxhash64(*df.columns), "__size": size, "__group": group}).filter((F.col("__size") <= max_bytes // 64) & F.col("__group").isNotNull())
    order = F.struct(F.pmod("__hash", F.lit(1 << 40)).alias("key"), F.col("__hash").alias("hash"))
    known = hashed.groupBy("__group").agg(F.count("*").alias("rows"), F.approx_count_distinct("__hash", 0.02).alias("different"), F.sum("__size").alias("bytes"))
    known = known.orderBy(F.desc("rows"), "__group").limit(max_groups).collect()
    out = hashed.filter(F.col("__group").isin([r["__group"] for r in known]))
    if sum(r["rows"] for r in known) <= n and sum(r["bytes"] for r in known) <= max_bytes:
        return out.drop("__hash", "__size", "__group")
    share, share_bytes = max(1, n // len(known)), max_bytes // len(known)
    wanted = share + 5 * share**0.5 + 10  # more than wanted, as hashes scatter and counts are approximate
    below = _by_group({r["__group"]: int((1 << 40) * min(1.0, 1.05 * wanted / max(r["different"], 1))) for r in known})
    under = out.filter(order["key"] < below)
    first = Window.partitionBy("__group").orderBy("key", "hash")
    picked = under.select("__group", "__size", order.alias("o")).select("__group", "__size", "o.*").dropDuplicates(["__group", "hash"])
    picked = picked.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= share).orderBy("__group", "at").collect()
    total, cut = dict.fromkeys((r["__group"] for r in known), 0), {}
    for r in picked:
        total[r["__group"]] += r["__size"]
        if total[r["__group"]] <= share_bytes:
            cut[r["__group"]] = (r["key"], r["hash"])
    last = F.struct(_by_group({g: k for g, (k, _) in cut.items()}).alias("key"), _by_group({g: h for g, (_, h) in cut.items()}).alias("hash"))
    return under.filter(last["key"].isNotNull() & (order <= last)).dropDuplicates(["__group", "__hash"]).drop("__hash", "__size", "__group")


def _by_group(value: dict[str, int]) -> Column:
    """The value of the row's group; null (no row) for a group without one."""
    return F.create_map(*[F.lit(x) for k, v in value.items() for x in (k, v)])[F.col("__group")] if value else F.lit(None).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, bounds): the bytes of a string or binary column; row i is data[bounds[i]:bounds[i + 1]]."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:  # a null may hide bytes
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Odd bases of the polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(p, out=p)
        if size <= 1 << 23:  # longer ones belong to a single very long text
            _powers[base] = p
    return p


class PolyHash:
    """Polynomial hashes of any slices of one sequence, from prefix sums (Rabin-Karp modulo 2**64)."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(base, n)[:n], out=self.prefix[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[end] - self.prefix[start]) * self.inverse[start]


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters as numbers, bounds in characters) of UTF-8 rows."""
    if not (data >= 128).any():
        return data.astype(np.uint32), bounds
    start = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[start].astype(np.uint32)
    tail = np.append(data, np.zeros(3, np.uint8))
    b, c, d = ((tail[start + i] & 0x3F).astype(np.uint32) for i in (1, 2, 3))
    two, three, four = (first & 0x1F) << 6 | b, (first & 0x0F) << 12 | b << 6 | c, (first & 0x07) << 18 | b << 12 | c << 6 | d
    return np.where(first < 0x80, first, np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))), np.searchsorted(start, bounds)


#: A fixed random 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: Space and the bytes 9 to 13 end words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z; other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are not ``space``: ``[^\\x20\\x09-\\x0D]+``) of each row: (start, end, first): row i has the words first[i]:first[i + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~space[data]
    begins = np.empty(len(data), bool)
    begins[0] = solid[0]
    begins[1:] = solid[1:] & ~solid[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = solid[cuts]
    start = np.flatnonzero(begins)
    ends = np.empty(len(data), bool)
    ends[-1] = solid[-1]
    ends[:-1] = solid[:-1] & ~solid[1:]
    last = cuts[cuts > 0] - 1
    ends[last] = solid[last]
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, bounds)


#: Low bytes of a 64-bit number that are kept for 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A keyed 64-bit hash of each word's bytes: the sum of its scrambled groups of 8 bytes, each under a key of its place. (No polynomial: those
    modulo 2**64 are equal for certain words whatever the base.) Words of at most 8 bytes and equal length never share one."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the 8 bytes from each byte on
    size = end - start
    groups = np.maximum(1, -(-size // 8))
    with np.errstate(over="ignore"):
        if groups.max() == 1:
            at, left, place = start, size, np.zeros(1, np.uint64)
        else:
            number = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
            at, left = np.repeat(start, groups) + 8 * number, np.minimum(np.repeat(size, groups) - 8 * number, 8)
            place = number.astype(np.uint64)
        first = np.uint64(key) ^ np.uint64(BASE)
        mixed = mix64((eight[at] & _LOW[left]) ^ mix64(place * np.uint64(SECOND_BASE) + first))
        h = mixed if len(mixed) == len(start) else np.add.reduceat(mixed, np.cumsum(groups) - groups)
        return mix64(h ^ mix64(size.astype(np.uint64) + first))


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0] + 1, ... of size[0], then those of the next slice."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def distinct_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a slice of each class, the class of each slice), for slices in order that do not overlap. Those of a class have equal bytes: they are found by
    hash and compared with the class's first slice; one whose bytes differ from it is a class of its own, unless another of those is equal to it."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = list(blocks(np.append(start, end[-1])))  # hashes and comparisons take several times the bytes
    hashes = [word_hashes(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]) for i, j in parts]
    _, first, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    del hashes
    size = end - start
    same = size == size[first[of]]
    for i, j in parts:
        check = np.arange(i, j)[same[i:j]]
        like = first[of[check]]
        check, like = check[check != like], like[check != like]
        different = data[gather(start[check], size[check])] != data[gather(start[like], size[check])]
        if different.any():
            same[check[np.repeat(np.arange(len(check)), size[check])[different]]] = False
    if not same.all():
        known: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~same).tolist():
            key = data[start[i] : end[i]].tobytes()
            if key not in known:
                known[key] = len(first) + len(more)
                more.append(i)
            of[i] = known[key]
        first = np.append(first, more)
    return first, of


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
