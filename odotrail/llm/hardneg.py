"""Hard-negative mining with Kronecker-packed integer products.

Scores are inner products of integer vectors. The components of several candidates are biased to be non-negative and laid
side by side in separated fields of one wide integer; one multiplication by an anchor's (biased) component then serves all
of them, and the sums of the fields are exact scores once the biases' share is taken off (``packed_products``). Fields are
as wide as the largest sum needs: two or three candidates a 64-bit word for usual vectors, Python integers for huge ones.

1. Rows that take part are written once, equal rows as one.
2. Anchors are dealt to groups and candidates to slices, both by hash and of bounded size; a task scores one group against
   one slice, block by block. Every anchor meets every candidate (an exact search), candidates travel once a group of
   anchors, anchors once a slice.
3. First pass: each task returns an anchor's best rows of the same label, and Spark merges these to its positives.
4. Second pass: each task returns, for each anchor and positive, the best rows of other labels within the window
   low * positive <= 100 * negative <= high * positive, and Spark merges these.

Cases: rows with a null id, label or vector, or with a null or non-finite component (also after scaling), take no part. Vectors
are compared with those of equal length only; the score of two empty ones is 0. Ties go to the smaller id. Rows of the anchor's
id are no others. Equal rows count once; of an id with several rows an anchor sees each positive and each negative once, at its
best score that counts; as anchors, different rows of an id are answered each. Scores beyond 64 bits are held at the
largest (least) such number. A positive whose window holds no row gives no rows, nor does an anchor without another row of
its label. An empty table gives no rows. Columns other than id, label and vector are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Anchors of a group and candidates of a slice take this many bytes, as 64-bit integers; a block of scores about as many.
GROUP_BYTES = 8 << 20
SLICE_BYTES = 32 << 20
#: A slice has at least so many rows, if the table has as many.
SLICE_ROWS = 1024
BLOCK_ANCHORS, BLOCK_CANDIDATES = 256, 4096
#: Components below this are narrow; others are kept apart, so that a few huge vectors do not slow the rest.
NARROW = 1 << 25
#: Fields of a Python integer.
WIDE_FIELDS = 8
LEAST = -(1 << 63)


def quantized(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where these do not hold them."""
    x = np.floor(vectors.astype(float) * scale)
    if not x.size or np.abs(x).max() < 1 << 62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The exact inner product of every anchor (row) and candidate; as Python integers if 64 bits do not hold them."""
    (rows, d), n = anchors.shape, len(candidates)
    if not rows or not n or not d:
        return np.zeros((rows, n), np.int64)
    size = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    wide = d * size(anchors) * size(candidates) >= 1 << 60
    anchors, candidates = (x.astype(object if wide else np.int64) for x in (anchors, candidates))
    low_a, low_c = int(anchors.min()), int(candidates.min())
    a, c = anchors - low_a, candidates - low_c
    width = max(1, (d * int(a.max()) * int(c.max())).bit_length())
    kind, fields = (object, WIDE_FIELDS) if wide else (np.uint64, 64 // width)
    shift = [f * width if wide else np.uint64(f * width) for f in range(fields)]
    a, c = a.astype(kind), c.astype(kind)
    packed = np.zeros((-(-n // fields), d), kind)
    for f in range(fields):
        part = c[f::fields]
        packed[: len(part)] |= part << shift[f]
    product = a @ packed.T if wide else np.einsum("ij,jk->ik", a, np.ascontiguousarray(packed.T))
    mask = (1 << width) - 1 if wide else np.uint64((1 << width) - 1)
    out = np.empty((rows, len(packed) * fields), object if wide else np.int64)
    for f in range(fields):
        out[:, f::fields] = (product >> shift[f]) & mask
    out = out[:, :n]
    out += low_c * anchors.sum(1)[:, None] - d * low_a * low_c
    out += low_a * candidates.sum(1)[None, :]
    return out


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """``packed_products``, as 64-bit integers."""
    s = packed_products(anchors, candidates)
    return s if s.dtype == np.int64 else np.clip(s, LEAST + 1, -LEAST - 1).astype(np.int64)


def by_size(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers of narrow vectors and of the others."""
    if not x.size:
        return [np.arange(len(x))]
    narrow = (x.max(1) < NARROW) & (x.min(1) > -NARROW)
    return [at for at in (np.flatnonzero(narrow), np.flatnonzero(~narrow)) if len(at)]


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``k`` best distinct ids of each row; ``ids`` are sorted, ``LEAST`` is no score."""
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    if len(begin) < len(ids):
        s, ids = np.maximum.reduceat(s, begin, axis=1), ids[begin]
    if len(ids) > k:
        cut = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None]
        over, tied = s > cut, s == cut
        taken = over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(1, keepdims=True)))
    else:
        taken = np.ones(s.shape, bool)
    row, column = np.nonzero(taken & (s != LEAST))
    return row, ids[column], s[row, column]


def _matrix(t: pa.Table, scale: float) -> np.ndarray:
    vectors = t.column("vector").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    return quantized(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1), scale) if len(t) and len(vectors[0]) else np.zeros((len(t), 0), np.int64)


def _sides(left: pa.Table, right: pa.Table, scale: float):
    right = right.sort_by("id")
    return _matrix(left, scale), _matrix(right, scale), left.column("id").to_numpy(), right.column("id").to_numpy(), left.column("label").to_numpy(), right.column("label").to_numpy()


def _blocks(rows: np.ndarray, size: int):
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


FOUND = "anchor_id long, anchor_key long, id long, score long"


def _positives(k: int, scale: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(left) and len(right):
            a, c, a_id, c_id, a_label, c_label = _sides(left, right, scale)
            key = left.column("key").to_numpy()
            a_order, c_order = np.argsort(a_label, kind="stable"), np.argsort(c_label, kind="stable")
            for label in np.intersect1d(a_label, c_label):
                mine, theirs = ((o[np.searchsorted(x[o], label) : np.searchsorted(x[o], label, "right")]) for o, x in ((a_order, a_label), (c_order, c_label)))
                for x in (mine[i] for i in by_size(a[mine])):
                    for y in (theirs[i] for i in by_size(c[theirs])):
                        for p in _blocks(x, BLOCK_ANCHORS):
                            for q in _blocks(y, BLOCK_CANDIDATES):
                                s = scores(a[p], c[q])
                                s[a_id[p][:, None] == c_id[q]] = LEAST
                                row, ids, found = best(s, c_id[q], k)
                                for o, v in zip(out, (a_id[p][row], key[p][row], ids, found), strict=True):
                                    o.append(v)
        return pa.table([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], names=["anchor_id", "anchor_key", "id", "score"])

    return run


WINDOWS = "anchor_id long, anchor_key long, positive_id long, positive_score long, id long, score long"


def _negatives(k: int, low: int, high: int, scale: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            a, c, a_id, c_id, a_label, c_label = _sides(left, right, scale)
            key, positives = left.column("key").to_pylist(), left.column("positives").to_pylist()
            # 64-bit scores within low * p <= 100 * s <= high * p
            inside = [[(-(-low * p["score"] // 100), high * p["score"] // 100) for p in ps] for ps in positives]
            floor = np.array([max(min(lo for lo, _ in w), LEAST + 1) for w in inside])
            ceiling = np.array([max(hi for _, hi in w) for w in inside])
            for x in by_size(a):
                for y in by_size(c):
                    for p in _blocks(x, BLOCK_ANCHORS):
                        for q in _blocks(y, BLOCK_CANDIDATES):
                            s = scores(a[p], c[q])
                            row, column = np.nonzero((s >= floor[p, None]) & (s <= ceiling[p, None]) & (a_label[p][:, None] != c_label[q]))
                            found = s[row, column]
                            order = np.lexsort((column, -found, row))  # columns are sorted by id
                            row, found, ids = row[order], found[order], c_id[q[column[order]]]
                            cut = np.searchsorted(row, np.arange(len(p) + 1))
                            for i in np.flatnonzero(np.diff(cut)).tolist():
                                mine, names, at = found[cut[i] : cut[i + 1]], ids[cut[i] : cut[i + 1]], int(p[i])
                                for (lo, hi), positive in zip(inside[at], positives[at], strict=True):
                                    seen: set[int] = set()
                                    for j in range(int(np.searchsorted(-mine, -hi)), len(mine)):
                                        if len(seen) == k or mine[j] < lo:
                                            break
                                        if names[j] not in seen:
                                            seen.add(names[j])
                                            out.append((a_id[at], key[at], positive["id"], positive["score"], names[j], mine[j]))
        names = [f.split()[0] for f in WINDOWS.split(", ")]
        return pa.table([pa.array(o, pa.int64()) for o in (zip(*out, strict=True) if out else [[]] * 6)], names=names)

    return run


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` distinct ids of each key, with their rank."""
    once = found.groupBy(*keys, "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def mine(table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", group_bytes: int = GROUP_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``anchors`` chooses and each of its
    ``positives`` best rows of its label, the ``negatives`` best rows of other labels within ``low`` to ``high`` per cent of the positive's score."""
    vector, label = F.col(vector_col), F.col(label_col) if isinstance(label_col, str) else label_col
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & _usable(scale))
    rows = materialize(rows.dropDuplicates().withColumns({"d": F.size("vector"), "key": F.xxhash64("label", "vector")}), "mining-rows")
    n = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.coalesce(F.max("d"), F.lit(0)).alias("d")).first()
    row_bytes = 8 * (n["d"] + 4)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n["anchors"] * row_bytes // group_bytes))
    slices = max(1, -(-n["n"] * row_bytes // slice_bytes), min(-(-parts // groups), -(-n["n"] // SLICE_ROWS)))
    dealt = lambda by, of: F.pmod(F.xxhash64("id", "key", F.lit(by)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    candidates = rows.select("id", "label", "vector", "d", dealt("slice", slices).alias("slice")).select("*", every(groups).alias("group"))
    asking = rows.filter("anchor").select("id", "key", "label", "vector", "d", dealt("group", groups).alias("group"))
    at = ["d", "group", "slice"]

    def asked(columns: DataFrame) -> DataFrame:
        out = columns.select("*", every(slices).alias("slice"))
        return out.toDF(*out.columns)  # names of their own, as both sides come from one table

    found = asked(asking).groupBy(*at).cogroup(candidates.groupBy(*at)).applyInArrow(_positives(positives, scale), FOUND)
    chosen = _first(found, ["anchor_id", "anchor_key"], positives).groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    chosen = materialize(chosen, "mining-positives").withColumnsRenamed({"anchor_id": "id", "anchor_key": "key"})
    found = asked(asking.join(chosen, ["id", "key"])).groupBy(*at).cogroup(candidates.groupBy(*at)).applyInArrow(_negatives(negatives, low, high, scale), WINDOWS)
    out = _first(found, ["anchor_id", "anchor_key", "positive_id", "positive_score"], negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _usable(scale: float) -> Column:
    """No component is null, NaN (which is above all numbers) or infinite, before or after scaling."""
    return F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double") * F.lit(scale)) < float("inf")))
