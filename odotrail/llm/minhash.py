"""MinHash near-duplicate detection with circulant signatures and exact verification.

1. Every text becomes its set of distinct word shingles, told by keyed hashes. Texts with equal sets are one node (named by a
   128-bit digest of the set's hashes, of 64 bits, and of the sum of second ones under another key), so copies are never compared. The keys are drawn anew for
   each run, so no text can be made to collide.
2. Circulant MinHash: one permutation scatters the shingles over ``UNIVERSE`` places, a second one, shifted
   by 0, 1, 2, ... places, gives all signature coordinates. (Li and Li, "C-MinHash", 2022.) ``bands`` bands
   of ``rows`` coordinates each name the buckets of a node.
3. Every node of a bucket is compared with the bucket's smallest node, on full sets of the words themselves; connected
   components of these links are formed in Spark.
4. A bucket whose nodes are now in one component has nothing left to say, and one of two nodes is done. All other
   buckets are verified whole, those with equal members once: a prefix filter, which loses no pair at the threshold,
   and a union-find that starts from the components yield the links that join them.
5. Components of all links; the smallest id of each is its name.

So every pair of nodes that share a bucket is linked if it is similar enough, or is joined through others. Small groups
are packed together; of a larger group than ``GROUP_NODES`` nodes or ``GROUP_SHINGLES`` shingles, the smallest node is
copied to several tasks (3), or blocks of nodes are verified pair by pair (4): no task holds more than two blocks. At most one
link a node and task is returned, never all pairs.

The number of bands follows from the threshold: a pair right at it is missed with probability ``MISS`` (24 bands of 5
coordinates at similarity 0.85, 35 at 0.8).

Cases: texts without words (and null texts) have an empty set, are linked with nothing and stay. A text with
fewer words than a shingle has its whole sequence as its only one. Rows with null id join groups but never
name them (a component of null ids alone has a null name). Repeated rows share a node; all rows that have a component's
smallest id are kept. Very long texts are groups of their own, compared whole. An empty table gives no rows. Columns other
than id and text are ignored, whatever their names. Texts are read as bytes, valid UTF-8 or not.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BASE, SECOND_BASE, PolyHash, blocks, distinct_slices, materialize, mix64, utf8, word_hashes, words
from .graph import connected_components, hot_limit, join_counted

UNIVERSE = 1 << 18
#: Largest group, in nodes and in shingles, that one task verifies alone; and the nodes of a pack of small groups.
GROUP_NODES = 1000
GROUP_SHINGLES = 1_000_000
PACK_NODES = 500
PACK_SHINGLES = 500_000
#: Probability that no band of a pair right at the threshold agrees.
MISS = 1e-6


def bands_for(percent: int, rows: int) -> int:
    return max(1, math.floor(math.log(MISS) / math.log1p(-((percent / 100) ** rows)) + 0.5)) if percent < 100 else 1


def _shingles(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, word after the last) of all shingles of rows with the words first[i]:first[i + 1]."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    return row, at, np.minimum(at + size, first[row + 1])


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(one shingle of each value in a row, by row and value; bounds of the rows)."""
    order = np.lexsort((h, row))
    x, y = h[order], row[order]
    order = order[np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))] if len(h) else order
    return order, np.searchsorted(row[order], np.arange(rows + 1))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int, keys: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all rows, sorted within each row; second hashes of the same; bounds of the rows)."""
    data = ASCII_LOWER[data]
    start, end, first = words(data, bounds)
    row, at, stop = _shingles(first, size)
    h, second = (mix64(PolyHash(word_hashes(data, start, end, key), base).slices(at, stop) ^ (stop - at).astype(np.uint64)) for key, base in zip(keys, (BASE, SECOND_BASE), strict=True))
    order, cut = _distinct(row, h, len(bounds) - 1)
    return h[order], second[order], cut


def exact_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the distinct shingles of all rows, sorted within each row; bounds of the rows). Equal numbers are shingles of equal words: words are
    numbered by their bytes, and shingles by the numbers of their words."""
    data = ASCII_LOWER[data]
    start, end, first = words(data, bounds)
    _, word = distinct_slices(data, start, end)
    del data, start, end
    row, at, stop = _shingles(first, size)
    word = np.append(word + 1, np.zeros(size, np.int64))
    number = np.zeros(len(row), np.int64)
    for k in range(size):  # one more word, or none (0)
        number *= len(word)
        number += np.where(at + k < stop, word[at + k], 0)
        number = np.unique(number, return_inverse=True)[1]
    order, cut = _distinct(row, number, len(bounds) - 1)
    return number[order], cut


class Circulant:
    """Signatures of ``coordinates`` numbers from two permutations."""

    def __init__(self, coordinates: int, seed: int = 11):
        p = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint32)
        self.coordinates = coordinates
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.append(p, p[: coordinates - 1]), coordinates)

    def signatures(self, shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """bounds: rows x 1, none empty. -> rows x coordinates."""
        place = (mix64(shingles) % np.uint64(UNIVERSE)).astype(np.int64)
        out = np.full((len(bounds) - 1, self.coordinates), UNIVERSE, np.uint32)
        for i, j in blocks(bounds, 4096):
            for lo in range(bounds[i], bounds[j], 16384):  # one row may be long
                hi = min(lo + 16384, bounds[j])
                cut = np.clip(bounds[i : j + 1], lo, hi)
                rows = np.flatnonzero(np.diff(cut)) + i
                part = np.minimum.reduceat(self.shifted[place[lo:hi]], cut[rows - i] - lo, axis=0)
                out[rows] = np.minimum(out[rows], part)
        return out


def _sketch(shingle: int, bands: int, rows: int, word_keys: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        salt = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            data, bounds = utf8(b.column(2))
            for i, j in blocks(bounds):
                sets, second, cut = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle, word_keys)
                n = np.diff(cut)
                full = np.flatnonzero(n)
                keys = np.zeros((len(n), bands), np.uint64)
                if len(full):
                    sig = circulant.signatures(sets, np.append(cut[full], cut[-1])).reshape(len(full), bands, rows)
                    h = np.zeros((len(full), bands), np.uint64) + salt
                    for k in range(rows):
                        h = mix64(h ^ sig[:, :, k].astype(np.uint64))
                    keys[full] = h
                raw = memoryview(sets).cast("B")
                with np.errstate(over="ignore"):
                    sums = np.diff(np.append(np.uint64(0), np.cumsum(second))[cut]).tolist()
                node = [hashlib.blake2b(raw[8 * s : 8 * e], digest_size=16, key=x.to_bytes(8, "little")).digest() if e > s else None for s, e, x in zip(cut[:-1].tolist(), cut[1:].tolist(), sums, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(np.frombuffer(b"".join(x[:8] if x else bytes(8) for x in node), np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))],
                    names=["id", "text_hash", "n", "node", "short", "keys"],
                )

    return run


def link_sets(sets: list[np.ndarray], percent: int, same: list | None = None) -> list[int]:
    """The component (a member's index) of each set, over all pairs with 100 * intersection >= percent * union; sets
    with equal values of ``same`` are in one component from the start.

    Sets are taken by size; a pair at the threshold shares one of the rarest size - ceil(percent * size / 100) + 1
    elements of each. Posting lists are kept by component, so that members already joined are not compared.
    """
    first: dict = {}
    parent = list(range(len(sets))) if same is None else [first.setdefault(x, i) for i, x in enumerate(same)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    shared = np.zeros(len(counts), bool)
    shared[rank] = counts > 1
    ranked = np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])
    members = [set(r.tolist()) for r in ranked]
    postings: dict[int, dict[int, list[int]]] = {}
    for x in sorted(range(len(sets)), key=lambda i: (len(members[i]), i)):
        size = len(members[x])
        prefix = np.sort(ranked[x])[: size - -(-percent * size // 100) + 1]
        checked = set()
        for token in prefix[shared[prefix]].tolist():
            lists = postings.setdefault(token, {})
            for root in list(lists):
                now = find(root)
                if now != root:
                    lists.setdefault(now, []).extend(lists.pop(root))
            for root, ys in list(lists.items()):
                if find(root) == find(x):
                    continue
                for y in ys:
                    if y in checked or 100 * len(members[y]) < percent * size:
                        continue
                    checked.add(y)
                    both = len(members[x] & members[y])
                    if 100 * both >= percent * (size + len(members[y]) - both):
                        parent[find(x)] = find(y)
                        break
            lists.setdefault(find(x), []).append(x)
    return [find(i) for i in range(len(sets))]


LINKS = "a binary, b binary"


def _links(a: list[bytes], b: list[bytes]) -> pa.Table:
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _by_label(group: pa.Table, shingle: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows sorted by label and node, where labels begin, their exact shingle sets and bounds)."""
    group = group.sort_by([("label", "ascending"), ("node", "ascending")]).combine_chunks()
    label = group.column("label").to_numpy()
    return group, np.append(np.flatnonzero(np.append(True, label[1:] != label[:-1])), len(label)), *exact_sets(*utf8(group.column("text").chunk(0)), shingle)


def _verify_stars(shingle: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links between the nodes of each label and the label's own node."""
        group, cut, sets, bounds = _by_label(group, shingle)
        node, hub = group.column("node").to_pylist(), group.column("short").to_numpy() == group.column("label").to_numpy()
        a, b = [], []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            tokens, at = sets[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s]
            row = np.repeat(np.arange(e - s), np.diff(at))
            for h in np.flatnonzero(hub[s:e]).tolist():
                mine = tokens[at[h] : at[h + 1]]
                place = np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)
                both = np.bincount(row[mine[place] == tokens], minlength=e - s)
                linked = 100 * both >= percent * (np.diff(at) + len(mine) - both)
                for i in np.flatnonzero(linked).tolist():
                    if node[s + i] != node[s + h]:
                        a.append(node[s + i])
                        b.append(node[s + h])
        return _links(a, b)

    return run


def _verify_groups(shingle: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links that join the components of each label's nodes."""
        group, cut, sets, bounds = _by_label(group, shingle)
        node, component = group.column("node").to_pylist(), group.column("component").to_pylist()
        a, b = [], []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if len(set(component[s:e])) < 2:
                continue
            tokens, at = sets[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s]
            for i, root in enumerate(link_sets(np.split(tokens, at[1:-1]), percent, component[s:e])):
                if component[s + root] != component[s + i]:
                    a.append(node[s + i])
                    b.append(node[s + root])
        return _links(a, b)

    return run


def _tasks(placed: DataFrame, group_nodes: int, group_shingles: int, pairs: bool) -> DataFrame:
    """placed: label, short, n (shingles). -> short and ``places``: (label, task) for each label of it. A small label's task
    is a pack; a large one has tasks for parts of its nodes (and its own node in all), or for ``pairs`` of them."""
    limit = hot_limit(placed.count())
    sizes = placed.groupBy("label").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    total = sizes.agg(F.sum("n").alias("nodes"), F.sum("shingles").alias("shingles")).first()
    packs = max(1, -(-(total["nodes"] or 0) // PACK_NODES), -(-(total["shingles"] or 0) // PACK_SHINGLES))
    count = F.greatest(F.ceil(F.col("n") / group_nodes), F.ceil(F.col("shingles") / group_shingles)).cast("long")
    joined = join_counted(placed.select("label", "short"), sizes.select("label", "n", count.alias("parts")), "label", limit)
    part = F.pmod(F.xxhash64("short", F.lit(1)), "parts")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    task = lambda g, i, j: F.struct("label", F.struct(g.cast("long").alias("g"), i.cast("long").alias("i"), j.cast("long").alias("j")).alias("task"))
    none = F.lit(-1)
    alone = F.array(task(F.pmod(F.xxhash64("label"), F.lit(packs)), none, none))
    if pairs:
        split = F.transform(every, lambda o: task(F.col("label"), F.least(o, part), F.greatest(o, part)))
    else:
        split = F.when(F.col("short") == F.col("label"), F.transform(every, lambda o: task(F.col("label"), o, none))).otherwise(F.array(task(F.col("label"), part, none)))
    chosen = joined.select("short", F.explode(F.when(F.col("parts") == 1, alone).otherwise(split)).alias("place"))
    return chosen.groupBy("short").agg(F.collect_list("place").alias("places"))  # bands, and parts of one's own label, bound these


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int | None = None, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", group_nodes: int = GROUP_NODES, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept (also text_hash, which with the id names a row's text, and
    component, which tells components apart whose smallest ids are equal; null for an empty set)."""
    bands = bands or bands_for(percent, rows)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    sketch = materialize(source.mapInArrow(_sketch(shingle, bands, rows, (secrets.randbits(64), secrets.randbits(64))), "id long, text_hash long, n long, node binary, short long, keys array<long>"), "sketches")
    nodes = sketch.filter("node is not null").groupBy("node").agg(F.min(F.struct("id", "text_hash", "short", "n", "keys")).alias("r"), F.min("id").alias("first")).select("node", "r.*", "first")
    nodes = materialize(nodes, "nodes")

    keyed = nodes.select("short", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("short").alias("hub"), F.max("short").alias("top"), F.count("*").alias("n")).filter("hub <> top").drop("top")
    buckets = materialize(buckets, "buckets")
    members = materialize(join_counted(keyed, buckets, "key", hot_limit(bands * nodes.count())), "bucket-members")
    found = nodes.drop("keys", "first").join(members.select("short").distinct(), "short")
    texts = source.join(found, (source.id.eqNullSafe(found.id)) & (source.text_hash == found.text_hash)).select("node", "short", "n", "text").dropDuplicates(["node"])
    texts = materialize(texts, "candidate-texts")

    stars = members.filter("short <> hub").select(F.col("hub").alias("label"), "short").union(members.select("hub", "hub")).distinct()
    stars = materialize(stars.join(texts.select("short", "n"), "short"), "star-members")
    stars = _tasks(stars, group_nodes, group_shingles, False)
    sent = texts.join(stars, "short").select("short", "node", F.explode("places").alias("p"), "text").select("p.task", "p.label", "short", "node", "text")
    links = materialize(sent.groupBy("task").applyInArrow(_without_task(_verify_stars(shingle, percent)), LINKS), "star-links")
    named = connected_components(links)

    owner = texts.select("short", "node").join(named, "node", "left").select("short", F.coalesce("component", "node").alias("component"))
    owner = materialize(owner.groupBy("short").agg(F.min("component").alias("component")), "candidate-components")
    in_bucket = members.join(owner, "short").select("key", "short", "component")
    print_of = [F.sum(F.xxhash64("short").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("short", F.lit(7))).alias("bits")]
    still_open = in_bucket.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), *print_of).filter("n > 2 and low <> high")
    still_open = still_open.groupBy("n", "total", "bits").agg(F.min("key").alias("key")).select("key", "n")
    rest = join_counted(in_bucket.select("key", "short"), still_open, "key", hot_limit(members.count())).select(F.col("key").alias("label"), "short")
    rest = materialize(rest.join(texts.select("short", "n"), "short"), "open-buckets")
    if rest.limit(1).count():
        groups = _tasks(rest, group_nodes, group_shingles, True)
        sent = texts.join(owner, "short").join(groups, "short").select("node", "component", F.explode("places").alias("p"), "text").select("p.task", "p.label", "node", "component", "text")
        more = materialize(sent.groupBy("task").applyInArrow(_without_task(_verify_groups(shingle, percent)), LINKS), "group-links")
        named = connected_components(links.union(more))

    smallest = nodes.select("node", "first").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = materialize(smallest, "components")
    first = smallest.groupBy("component").agg(F.min("first").alias("component_id"))
    lookup = smallest.join(first, "component").select("node", "component", "component_id")
    out = sketch.select("id", "text_hash", "n", "node").join(lookup, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash", "component")


def _without_task(verify):
    def run(group: pa.Table) -> pa.Table:
        return verify(group.drop_columns(["task"]))

    return run
