"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree halves the vectors at the median along the direction between two random ones. A query searches all
trees through one priority queue: the part of any tree whose path crosses the least squared distance to its
splits comes next, until the wanted number of leaves is open. The vectors of the opened leaves are ranked
exactly, in double precision (single precision, with a margin for its error, picks those that can be among the best). (Vectors get one more coordinate that gives all the same norm, so that the largest
inner product is the least distance.)

Learning: the splits, and the number of leaves to open (the least that finds ``target`` of the true neighbours
of sampled queries), come from a bounded sample of ``max_sample`` vectors. Every vector is indexed.

Distribution: every tree has about one leaf a ``leaf_rows`` vectors, up to ``max_leaves`` leaves (beyond
``leaf_rows * max_leaves`` vectors leaves grow, as the forest is broadcast). A tree's leaves are dealt in groups of
neighbouring leaves with about ``group_rows`` vectors, and a group's vectors in pieces of that size where it has more.
Indexed vectors and queries meet by group and piece, so no task holds more vectors than a piece; it streams its queries.
Past ``salt_queries`` queries the index is copied to share them among tasks: a copy costs one vector's bytes for that
many queries' work. Equal vectors are indexed once with their smallest ids, which is all that can be returned of them.

Cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite numbers take
no part, as candidates or as queries. Ties go to the smaller id. With fewer candidates than ``k`` all are
returned, if their leaves are opened (a table no larger than one leaf is searched whole). Rows that repeat an id
are candidates each, but the id is returned once, with its best score; as queries, different vectors of an id are
answered each. An empty table gives no rows. Columns other
than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_sample, materialize


@dataclass
class Forest:
    """Inner nodes: direction, cut; children: two node numbers, or -1 - leaf. roots: one per tree. open_leaves: leaves a query opens."""

    direction: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    roots: list[int]
    tree_of_leaf: np.ndarray
    radius2: float
    open_leaves: int

    @staticmethod
    def fit(x: np.ndarray, radius2: float, trees: int, leaves: int, k: int, target: float, seed: int = 5) -> Forest:
        """x: sampled vectors (before the added coordinate); leaves: wanted for each tree, a power of two."""
        r = np.random.default_rng(seed)
        wide = lift(x, radius2)
        direction, cut, children, tree_of_leaf = [], [], [], []

        def grow(rows: np.ndarray, tree: int, depth: int) -> int:
            if depth == 0 or len(rows) < 2:
                tree_of_leaf.append(tree)
                return -len(tree_of_leaf)
            a, b = r.choice(len(rows), 2, replace=False)
            d = wide[rows[a]] - wide[rows[b]]
            size = np.linalg.norm(d)
            d = d / size if size > 0 else (lambda v: v / np.linalg.norm(v))(r.normal(size=wide.shape[1]))
            p = wide[rows] @ d
            at = float(np.median(p))
            me = len(cut)
            direction.append(d)
            cut.append(at)
            children.append([0, 0])
            low = p <= at
            children[me] = [grow(rows[low], tree, depth - 1), grow(rows[~low], tree, depth - 1)]
            return me

        roots = [grow(np.arange(len(wide)), t, int(np.log2(leaves))) for t in range(trees)]
        forest = Forest(np.array(direction).reshape(-1, wide.shape[1]), np.array(cut), np.array(children, int).reshape(-1, 2), roots, np.array(tree_of_leaf), radius2, len(tree_of_leaf))
        forest.open_leaves = forest.calibrate(x, k, target, r)
        return forest

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree: rows x trees."""
        wide = lift(x, self.radius2)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = np.einsum("ij,ij->i", wide[inner], self.direction[at]) > self.cut[at]
                node[inner] = self.children[at, side.astype(int)]
            out[:, t] = -1 - node
        return out

    def search(self, x: np.ndarray, n: int) -> list[list[int]]:
        """For each query the first ``n`` leaves, all trees sharing one priority queue."""
        if not len(self.cut):
            return [list(range(len(self.tree_of_leaf)))[:n] for _ in x]
        wide = np.hstack([x, np.zeros((len(x), 1))])
        children = self.children.tolist()
        out = []
        for q in wide:
            margin = (self.direction @ q - self.cut).tolist()
            queue = [(0.0, root) for root in self.roots]
            heapq.heapify(queue)
            leaves = []
            while queue and len(leaves) < n:
                cost, node = heapq.heappop(queue)
                while node >= 0:  # the near side costs nothing more, so it comes next
                    m = margin[node]
                    near = m > 0
                    heapq.heappush(queue, (cost + m * m, children[node][not near]))
                    node = children[node][near]
                leaves.append(-1 - node)
            out.append(leaves)
        return out

    def calibrate(self, x: np.ndarray, k: int, target: float, r: np.random.Generator, queries: int = 100) -> int:
        """Leaves to open so that sampled queries find the share ``target`` of their ``k`` true neighbours in the sample."""
        total = len(self.tree_of_leaf)
        if len(x) <= k + 1 or total == len(self.roots):
            return total
        chosen = r.choice(len(x), min(queries, len(x)), replace=False)
        leaf = self.assign(x)
        found = np.zeros(total + 1)
        for q, order in zip(chosen, self.search(x[chosen], total), strict=True):
            score = x @ x[q]
            score[q] = -np.inf
            position = np.empty(total, np.int64)
            position[order] = np.arange(total)
            best = np.argpartition(-score, k)[:k]
            np.add.at(found, position[leaf[best]].min(1) + 1, 1)
        return int(np.searchsorted(np.cumsum(found) / found.sum(), target)) or 1


def lift(x: np.ndarray, radius2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, radius2 - np.einsum("ij,ij->i", x, x)))[:, None]])


def usable(c: str) -> Column:
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.col(c).isNotNull() & finite & F.exists(c, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


ROWS = "part int, piece int, salt int, kind int, leaves array<int>, v array<double>, ids array<long>"


def _emit(part, piece, salt, kind, leaves, v, ids) -> pa.RecordBatch:
    numbers = [pa.array(x, pa.int32()) for x in (part, piece, salt, np.full(len(part), kind))]
    return pa.RecordBatch.from_arrays([*numbers, leaves, v, ids], names=["part", "piece", "salt", "kind", "leaves", "v", "ids"])


FOUND = pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())]))


def _found(q: pa.Array, n: np.ndarray, less: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    pairs = pa.StructArray.from_arrays([pa.array(less), pa.array(who)], fields=list(FOUND.value_type))
    return pa.RecordBatch.from_arrays([q, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pairs)], names=["q", "found"])


def _spread(x: pa.Array, counts: np.ndarray) -> pa.Array:
    return x.take(pa.array(np.repeat(np.arange(len(x)), counts)))


def first_ids(owner: np.ndarray, less: np.ndarray, who: np.ndarray, n: int, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` least (less, who) of each owner, an id only with its least: (number of each owner's, less, who)."""
    order = np.lexsort((less, who, owner))
    owner, less, who = owner[order], less[order], who[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (who[1:] != who[:-1])) if len(who) else np.zeros(0, bool)
    owner, less, who = owner[fresh], less[fresh], who[fresh]
    order = np.lexsort((who, less, owner))
    owner, less, who = owner[order], less[order], who[order]
    few = np.arange(len(owner)) - np.searchsorted(owner, owner) < n
    return np.bincount(owner[few], minlength=owners), less[few], who[few]


def at_least(scores: np.ndarray, n: int) -> np.ndarray:
    """For each row a number that ``n`` of its entries reach, close to the n-th largest: of stretches' largest ones, where there are enough stretches."""
    stretches = scores.shape[1] // 64
    if n <= stretches:
        scores = scores[:, : 64 * stretches].reshape(len(scores), stretches, 64).max(2)
    return np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]


def best_of_block(x: np.ndarray, rough: np.ndarray, leaf: np.ndarray, ids: np.ndarray, cut: np.ndarray, q: np.ndarray, opened: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` best ids of each query among the vectors of its opened leaves: (number of each query's, minus scores, ids).

    rough: the vectors in single precision, scaled to a greatest length of one. They choose what is scored exactly: all whose
    rough score is within the rounding error of the last one wanted, more where that gives too few different ids."""
    distinct, place = np.unique(leaf, return_inverse=True)
    wanted = np.zeros((len(q), len(distinct)), bool)
    for i, leaves in enumerate(opened):
        at = np.searchsorted(distinct, leaves)
        wanted[i, at[(at < len(distinct)) & (distinct[np.minimum(at, len(distinct) - 1)] == leaves)]] = True
    scores = (q / np.linalg.norm(q, axis=1)[:, None]).astype(np.float32) @ rough.T
    np.copyto(scores, np.float32(-np.inf), where=~wanted[:, place])
    margin = np.float32(8 * q.shape[1] * np.finfo(np.float32).eps)
    least, take = np.full(len(q), np.finfo(np.float32).min), n
    while True:
        limit = least
        if take < len(x):
            limit = np.maximum(at_least(scores, take) - margin, least)
        row, col = np.nonzero(scores >= limit[:, None])
        exact = np.empty(len(row))
        for lo in range(0, len(row), 1 << 15):
            exact[lo : lo + (1 << 15)] = np.einsum("ij,ij->i", x[col[lo : lo + (1 << 15)]], q[row[lo : lo + (1 << 15)]])
        many = np.diff(cut)[col]
        who = ids[np.arange(many.sum()) + np.repeat(cut[col] - (np.cumsum(many) - many), many)]
        found = first_ids(np.repeat(row, many), np.repeat(-exact, many), who, n, len(q))
        if take >= len(x) or not ((found[0] < n) & (limit > least)).any():
            return found
        take *= 8  # some query's best vectors repeat ids


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = 4, leaf_rows: int = 200, group_bytes: int = 8 << 20, max_leaves: int = 4096, max_sample: int = 32_768, target: float = 0.95, salt_queries: int = 500_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row of ``vectors`` with ``queries`` true: query_id, rank (from 1), id, score of its ``k`` nearest others."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(usable("v") & F.col("id").isNotNull())
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not size:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    rows = rows.filter(F.size("v") == size["d"])
    first = Window.partitionBy("v").orderBy("id")
    points = rows.select("id", "v").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    points = materialize(points.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "points")
    asking = materialize(rows.filter("asks").groupBy("v").agg(F.min("id").alias("q")), "queries")

    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    known = points.agg(F.count("*").alias("n"), F.max(norm2).alias("radius2")).first()
    leaves = 1 << int(np.log2(max(1, min(known["n"] // leaf_rows, max_leaves))))
    wanted = min(max_sample, max(16_384, 8 * leaves))
    sample = np.array([r["v"] for r in bounded_sample(points.select("v"), wanted, "v").orderBy(F.xxhash64("v"), "v").collect()])
    leaves = min(leaves, 1 << int(np.log2(max(1, len(sample) // 4))))  # of small tables: the sample is all of them
    forest = Forest.fit(sample, known["radius2"], trees, leaves, k, target)
    shared = spark.sparkContext.broadcast(forest)
    group_rows = max(256, group_bytes // (8 * size["d"]))
    per_part = max(1, int(group_rows * len(forest.tree_of_leaf) / trees / known["n"]))  # neighbouring leaves of a tree
    salts = -(-max(1, asking.count()) // salt_queries)

    def part_of(leaf: np.ndarray, f: Forest) -> np.ndarray:
        return leaf // per_part * len(f.roots) + f.tree_of_leaf[leaf]

    def count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            part, n = np.unique(part_of(f.assign(_matrix(b.column(0))), f), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n)], names=["part", "n"])

    counted = points.select("v").mapInArrow(count_parts, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row a part of the forest
    pieces = np.ones(len(forest.tree_of_leaf) // per_part * trees + trees + 1, np.int64)
    for r in counted:
        pieces[r["part"]] = -(-r["n"] // (2 * group_rows))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = _matrix(b.column(0))
            leaf = f.assign(x)
            dealt = np.abs(x.view(np.int64).sum(1))
            for t in range(leaf.shape[1]):
                part = part_of(leaf[:, t], f)
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1), pa.int32()), pa.array(leaf[:, t], pa.int32()))
                for s in range(salts):
                    yield _emit(part, dealt % pieces[part], np.full(len(leaf), s), 0, one, b.column(0), b.column(1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                found, row, part, lists = f.search(_matrix(c.column(0)), f.open_leaves), [], [], []
                for i, leaves in enumerate(found):
                    leaves = np.sort(np.array(leaves))
                    p = part_of(leaves, f)
                    order = np.argsort(p, kind="stable")
                    p, leaves = p[order], leaves[order]
                    cut = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                    row.append(np.full(len(cut), i))
                    part.append(p[cut])
                    lists += np.split(leaves, cut[1:])
                row, part = np.concatenate(row), np.concatenate(part)
                opened = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                n = pieces[part]
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who = _spread(c.column(1).take(pa.array(row)), n)
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1), pa.int32()), who)
                yield _emit(np.repeat(part, n), piece, who.to_numpy() % salts, 1, _spread(opened, n), _spread(c.column(0).take(pa.array(row)), n), ids)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part, piece, salt, kind: a piece's vectors, then its queries."""
        key, held, index = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in (0, 1, 2, 3)], 1)
            cut = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                c, mine = b.slice(lo, hi - lo), tuple(keys[lo, :3])
                if mine != key:
                    key, held, index = mine, [], None
                if keys[lo, 3] == 0:
                    held.append(c)
                    continue
                if not held:
                    continue
                if index is None:
                    x = np.concatenate([_matrix(h.column(5)) for h in held])
                    lists = pa.concat_arrays([h.column(6) for h in held])
                    offsets = lists.offsets.to_numpy()
                    index = x, (x / np.linalg.norm(x, axis=1).max()).astype(np.float32), np.concatenate([h.column(4).flatten().to_numpy() for h in held]), lists.flatten().to_numpy(), offsets - offsets[0]
                step = max(1, min(256, (4 << 20) // len(index[0])))
                for at in range(0, c.num_rows, step):
                    some = c.slice(at, step)
                    opened = [np.array(o) for o in some.column(4).to_pylist()]
                    yield _found(some.column(6).flatten(), *best_of_block(*index, _matrix(some.column(5)), opened, k + 1))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by q: the best of all the lists of each query."""
        held = pa.Table.from_batches([], pa.schema([("q", pa.int64()), ("found", FOUND)]))
        for b in [*batches, None]:
            if b is not None:
                held = pa.concat_tables([held, pa.Table.from_batches([b]).cast(held.schema)]).combine_chunks()
            last = len(held) if b is None or not len(held) else pc.index(held.column(0), held.column(0)[-1]).as_py()
            done, held = held.slice(0, last), held.slice(last)
            if len(done):
                lists = done.column(1).combine_chunks()
                pairs = lists.flatten()
                q, owner = np.unique(done.column(0).to_numpy(), return_inverse=True)
                yield _found(pa.array(q), *first_ids(np.repeat(owner, np.diff(lists.offsets.to_numpy())), pairs.field(0).to_numpy(), pairs.field(1).to_numpy(), k + 1, len(q)))

    met = points.mapInArrow(index, ROWS).union(asking.mapInArrow(ask, ROWS)).repartition("part", "piece", "salt").sortWithinPartitions("part", "piece", "salt", "kind")
    kind = "q long, found array<struct<less: double, id: long>>"
    lists = met.mapInArrow(rank, kind).repartition("q").sortWithinPartitions("q").mapInArrow(merge, kind)
    who = rows.filter("asks").select(F.col("id").alias("query_id"), "v").distinct().join(asking, "v").select("query_id", "q").join(lists, "q")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    out = who.select("query_id", F.posexplode(others).alias("pos", "f"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias(id_col), (-F.col("f.less")).alias("score"))
