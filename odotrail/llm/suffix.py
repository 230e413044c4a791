"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

The bytes covered by any string of ``length`` bytes that also starts elsewhere are removed. Suffixes are
sampled: an anchor is the place of the smallest hashed ``SEED``-gram in some window of ``length`` bytes, so
every such window holds the anchor its own bytes choose, and equal windows hold equal anchors at one place.

1. Anchors' seeds are dealt to buckets as packed hashes; those found once only can't lie in a repeat.
2. The anchors found again bring their surroundings (the ``length`` bytes from the anchor on, and the bytes
   before it) to the bucket of their seed. Equal surroundings are merged, within a chunk before they travel.
   A seed of more than ``hot_suffixes`` anchors (a common line, say) is dealt further: a window that starts ``low`` to
   ``high`` bytes before its anchor holds the ``low`` bytes before it and ``length - high`` from it on, so for each of
   ``PARTS`` the surroundings that such windows can reach go to the bucket of these bytes, all but 20 of the window's.
3. Each bucket takes these suffixes batch by batch into a family of suffix arrays whose sizes double: a new
   batch is sorted, merge-scanned against every level for long matches, and merged with equal-sized levels
   (``SuffixFamily``). A match is extended to the left; if it reaches ``length`` bytes in all it is a repeat.
4. Each chunk joins the repeats into maximal runs of bytes for its documents, and these are cut out.

All matches are compared byte by byte; hashes only choose what is compared. The number of buckets grows with the
bytes of text, so a bucket does not (but for anchors of one text that more than ``length`` - 20 bytes repeat).

Cases: a null text counts as empty; shorter texts than ``length`` lose nothing. Repeated rows are repeats
of each other, whatever their ids (so there are no ties to break). A null id works as any other. An empty table gives
no rows. NUL bytes are bytes like others. Runs may begin or end within a character: the kept bytes need not be valid
UTF-8, so they are returned as a digest (or as binary). Very long texts are worked on in overlapping stretches. Columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, PolyHash, blocks, materialize, mix64, utf8
from .substring import bucket_count, chunks, keyed, pack_deltas, unpack_deltas

SEED = 40
CHUNK_BYTES = 8_000_000
#: Suffixes further apart than this in a suffix array are matched class by class instead of pair by pair.
NEAR = 24
#: Bytes that one numpy step of the anchors' search works on.
STEP = 4 << 20


def parts(length: int) -> list[tuple[int, int]]:
    """Distances (low, high) from a window's start to its anchor: first all of them, then split for hot seeds."""
    reach = length - SEED
    return [(0, reach), *[(low, min(low + 20, reach)) for low in range(0, reach, 20)]]


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) of the anchors of all windows of ``length`` bytes within the rows."""
    if len(data) <= STEP:
        return _anchors(data, bounds, length)
    found = []
    for lo in range(0, len(data), STEP):  # every window lies within the stretch that it starts in
        hi = min(len(data), lo + STEP + length - 1)
        at, h = _anchors(data[lo:hi], np.clip(bounds, lo, hi) - lo, length)
        found.append((at + lo, h))
    at, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    return at, np.concatenate([f[1] for f in found])[first]


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    span = length - SEED + 1
    n = len(data) - SEED + 1
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    h = mix64(PolyHash(BYTE_VALUES[data]).slices(at, at + SEED))
    least = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - span + 1], least[span - width : span - width + n - span + 1])
    whole = np.zeros(len(data) + 1, np.int32)  # starts of windows that lie within one row
    size = np.diff(bounds)
    ok = size >= length
    np.add.at(whole, bounds[:-1][ok], 1)
    np.add.at(whole, bounds[1:][ok] - length + 1, -1)
    least = least[np.cumsum(whole)[: len(least)] > 0]
    picked = np.zeros(n, bool)
    picked[(least & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    place = np.flatnonzero(picked)
    return place, h[place]


def _binary_batch(rows: list[tuple], names: list[str], first: list[pa.DataType]) -> pa.RecordBatch:
    kinds = [*first, *[pa.binary()] * (len(names) - len(first))]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


SEEDS = ["bucket", "chunk", "ids", "first", "text", "h", "at"]


def _send_seeds(buckets: int, length: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, text, data, bounds in chunks(batches, chunk_bytes):
            places, hashes = [], []
            for i, j in blocks(bounds):
                p, h = anchors(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], length)
                places.append(p + bounds[i])
                hashes.append(h)
            at, h = np.concatenate(places), np.concatenate(hashes)
            _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            again = pack_deltas(at[n[inverse] > 1])
            order = np.argsort(first)
            first, n = first[order], n[order].astype(np.uint32)
            at, h = at[first], h[first]
            bucket = (mix64(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at, h, n = at[order], h[order], n[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(int(number % buckets), number, ids.tobytes(), bounds.tobytes(), text.tobytes(), None, again)]
            rows += [(k, number, None, None, None, h[cut[k] : cut[k + 1]].tobytes() + np.minimum(n[cut[k] : cut[k + 1]], 255).astype(np.uint8).tobytes(), pack_deltas(at[cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)).tolist()]
            for k in range(0, len(rows), 64):
                yield _binary_batch(rows[k : k + 64], SEEDS, [pa.int32(), pa.int64()])

    return run


def _answer_seeds(hot_suffixes: int):
    def run(group: pa.Table) -> pa.Table:
        """Tells each chunk which of its seeds are found again; a row without a chunk holds the hot seeds (by counts of up to 255 a chunk)."""
        rows = group.to_pylist()
        out = [(r["chunk"], r["ids"], r["first"], r["text"], r["at"]) for r in rows if r["h"] is None]
        sent = [r for r in rows if r["h"] is not None]
        if sent:
            size = [len(r["h"]) // 9 for r in sent]
            seeds, inverse, n = np.unique(np.concatenate([np.frombuffer(r["h"], np.uint64, k) for r, k in zip(sent, size, strict=True)]), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, np.concatenate([np.frombuffer(r["h"], np.uint8, k, 8 * k) for r, k in zip(sent, size, strict=True)]))
            out.append((None, seeds[total > hot_suffixes].tobytes(), None, None, None))
            again = n[inverse] > 1
            at = 0
            for r, k in zip(sent, size, strict=True):
                mine = again[at : at + k]
                at += k
                if mine.any():
                    out.append((r["chunk"], None, None, None, pack_deltas(unpack_deltas(r["at"])[mine])))
        return pa.Table.from_batches([_binary_batch(out, ["chunk", "ids", "first", "text", "at"], [pa.int64()])])

    return run


def _anchors_of_documents(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids, bounds, text = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["first"], np.int64), np.frombuffer(head["text"], np.int64)
    at = np.unique(np.concatenate([unpack_deltas(r["at"]) for r in rows]))
    row = np.searchsorted(bounds, at, "right") - 1
    docs, n = np.unique(row, return_counts=True)
    cut = pa.array(np.append(0, np.cumsum(n)), pa.int32())
    return pa.table([pa.array(ids[docs]), pa.array(text[docs]), pa.ListArray.from_arrays(cut, pa.array(at - bounds[row], pa.int32()))], names=["__id", "__hash", "anchors"])


def sortable(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Zero-padded byte rows as strings in their true order: a row before all that it begins. (Rows that differ in closing
    zero bytes alone are told apart by their size, one byte more.)"""
    wide = np.concatenate([rows, sizes.astype(np.uint8)[:, None]], 1)
    return wide.view(f"S{wide.shape[1]}").ravel()


class SuffixFamily:
    """Suffix arrays over sampled suffixes, in levels whose sizes double.

    right: rows of ``length`` bytes from the anchor on; left: the bytes before it, backwards; both padded,
    with their true lengths. ``least[s]`` and ``most[s]``: among the windows that hold the anchor of suffix s and
    also start elsewhere, the least and the greatest distance from the window's start to the anchor (most < least:
    there are none). As all of them hold the anchor, these two bound the bytes that they cover together.
    """

    def __init__(self, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray):
        self.right, self.right_len, self.left, self.left_len = right, right_len, left, left_len
        self.length, self.reach = right.shape[1], left.shape[1]
        self.text = sortable(right, right_len)
        self.lowest = np.maximum(0, self.length - right_len)  # of the windows that fit
        self.least, self.most = np.full(len(right), self.reach + 1), np.full(len(right), -1)
        self.levels: dict[int, np.ndarray] = {}

    def cover(self, rows: np.ndarray) -> None:
        """All windows of ``rows`` also start elsewhere."""
        rows = rows[self.lowest[rows] <= self.left_len[rows]]
        self.least[rows], self.most[rows] = self.lowest[rows], self.left_len[rows]

    def done(self) -> np.ndarray:
        return (self.lowest > self.left_len) | ((self.least <= self.lowest) & (self.most >= self.left_len))

    def add(self, batch: np.ndarray) -> None:
        """Take in the suffixes numbered ``batch``."""
        new = batch[np.argsort(self.text[batch], kind="stable")]
        self.scan(new, np.ones(len(new), bool))
        for level in self.levels.values():
            merged, fresh = self.merge(level, new)
            self.scan(merged, fresh)
        size = 0
        while size in self.levels:  # equal sizes merge
            new, _ = self.merge(self.levels.pop(size), new)
            size += 1
        self.levels[size] = new

    def merge(self, level: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.text[level], self.text[new], "right") + np.arange(len(new))
        merged, fresh = np.empty(len(level) + len(new), np.int64), np.zeros(len(level) + len(new), bool)
        fresh[at] = True
        merged[at] = new
        merged[~fresh] = level
        return merged, fresh

    def common(self, bytes_: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b."""
        out = np.empty(len(a), np.int64)
        for lo in range(0, len(a), 8192):
            x, y = a[lo : lo + 8192], b[lo : lo + 8192]
            differ = bytes_[x] != bytes_[y]
            n = np.where(differ.any(1), differ.argmax(1), bytes_.shape[1])
            out[lo : lo + 8192] = np.minimum(n, np.minimum(sizes[x], sizes[y]))
        return out

    def scan(self, order: np.ndarray, fresh: np.ndarray) -> None:
        """Mark the repeats among the sorted suffixes ``order`` that concern a fresh one."""
        if len(order) < 2:
            return
        done = self.done()[order]
        lcp = self.common(self.right, self.right_len, order[:-1], order[1:])
        i = np.flatnonzero(lcp >= SEED)
        shared = lcp[i]
        for step in range(1, NEAR + 1):
            j = i + step
            use = (fresh[i] | fresh[j]) & ~(done[i] & done[j])
            a, b, right = order[i[use]], order[j[use]], shared[use]
            left = self.common(self.left, self.left_len, a, b)
            found = right + left >= self.length
            self.mark(a[found], b[found], self.length - right[found], left[found])
            go = i + step < len(lcp)
            i, shared = i[go], shared[go]
            shared = np.minimum(shared, lcp[i + step])
            i, shared = i[shared >= SEED], shared[shared >= SEED]
            if not len(i):
                return
        # large classes: for every distance d, suffixes with the same first length - d bytes and the same d bytes before
        run = np.concatenate(([0], np.cumsum(lcp < SEED)))
        for members in np.split(order, np.flatnonzero(np.diff(run)) + 1):
            if len(members) > NEAR:
                self.scan_class(members)

    def mark(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for x in (a, b):
            np.minimum.at(self.least, x, low)
            np.maximum.at(self.most, x, high)

    def scan_class(self, members: np.ndarray) -> None:
        if self.done()[members].all():
            return
        by_left = np.argsort(sortable(self.left[members], self.left_len[members]), kind="stable")
        left_lcp = self.common(self.left, self.left_len, members[by_left[:-1]], members[by_left[1:]])
        right_lcp = self.common(self.right, self.right_len, members[:-1], members[1:])
        left_class = np.empty(len(members), np.int64)
        for d in range(self.reach + 1):
            left_class[by_left] = np.concatenate(([0], np.cumsum(left_lcp < d)))
            key = np.concatenate(([0], np.cumsum(right_lcp < self.length - d))) * len(members) + left_class
            ok = np.flatnonzero((self.lowest[members] <= d) & (d <= self.left_len[members]))
            _, inverse, n = np.unique(key[ok], return_inverse=True, return_counts=True)
            found = members[ok[n[inverse] > 1]]
            self.least[found] = np.minimum(self.least[found], d)
            self.most[found] = np.maximum(self.most[found], d)


SURROUNDINGS = ["bucket", "chunk", "ids", "text", "doc", "at", "bytes", "runs"]


def _send_surroundings(buckets: int, length: int, chunk_bytes: int, hot):
    reach = length - SEED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, text = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, bounds = utf8(b.column(3))
            lists = b.column(2)
            cut = lists.offsets.to_numpy().astype(np.int64)
            at_all = lists.values.to_numpy()[cut[0] : cut[-1]].astype(np.int64)
            cut -= cut[0]
            for i, j in blocks(cut * length, chunk_bytes):  # by the size of what is sent
                doc = np.repeat(np.arange(i, j), np.diff(cut[i : j + 1]))
                at = at_all[cut[i] : cut[j]]
                place, begin, end = bounds[doc] + at, bounds[doc], bounds[doc + 1]
                right_len, left_len = np.minimum(end - place, length), np.minimum(place - begin, reach)
                wide = np.zeros((len(at), length + reach + 2), np.uint8)
                for lo in range(0, len(at), 4096):
                    p = place[lo : lo + 4096, None]
                    step = np.arange(length)
                    wide[lo : lo + 4096, :length] = np.where(step < right_len[lo : lo + 4096, None], data[np.minimum(p + step, len(data) - 1)], 0)
                    step = np.arange(reach)
                    wide[lo : lo + 4096, length:-2] = np.where(step < left_len[lo : lo + 4096, None], data[np.maximum(p - 1 - step, 0)], 0)
                seed = mix64(PolyHash(BYTE_VALUES[wide[:, :SEED]].ravel()).slices(np.arange(len(at)) * SEED, np.arange(1, len(at) + 1) * SEED))
                is_hot = np.isin(seed, hot.value)
                runs, rows = [], []
                for part, (low, high) in enumerate(parts(length)):
                    right, left = np.minimum(right_len, length - low), np.minimum(left_len, high)
                    mine = np.flatnonzero(is_hot & (left >= low) & (right + left >= length) if part else ~is_hot)
                    if not len(mine):
                        continue
                    w, right, left = wide[mine], right[mine], left[mine]
                    if part:
                        w[:, length - low : length], w[:, length + high : -2] = 0, 0
                    w[:, -2], w[:, -1] = right, left
                    _, first, inverse, n = np.unique(w.view(f"S{w.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
                    whole = (n[inverse] > 1) & (right + left >= length)
                    runs.append(np.stack([doc[mine] - i, at[mine] - left, at[mine] + right])[:, whole])
                    keep = np.sort(first)
                    w, held = w[keep], mine[keep]
                    if part:
                        shared = np.concatenate([w[:, length : length + low][:, ::-1], w[:, : length - high]], 1)
                        size = shared.shape[1]
                        key = mix64(PolyHash(BYTE_VALUES[shared].ravel()).slices(np.arange(len(w)) * size, np.arange(1, len(w) + 1) * size))
                    else:
                        key = seed[held]
                    bucket = (mix64(key ^ np.uint64(BASE)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    w, held = w[order], held[order]
                    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    for k in np.flatnonzero(np.diff(edge)).tolist():
                        lo, hi = edge[k], edge[k + 1]
                        rows.append((part * buckets + k, number, None, None, (doc[held[lo:hi]] - i).astype(np.uint32).tobytes(), at[held[lo:hi]].astype(np.uint32).tobytes(), zstandard.compress(w[lo:hi].tobytes(), 1), None))
                        if len(rows) == 64:
                            yield _binary_batch(rows, SURROUNDINGS, [pa.int32(), pa.int64()])
                            rows = []
                rows.append((int(number % buckets), number, ids[i:j].tobytes(), text[i:j].tobytes(), None, None, None, np.concatenate([np.zeros((3, 0), np.int64), *runs], 1).astype(np.int32).tobytes()))
                yield _binary_batch(rows, SURROUNDINGS, [pa.int32(), pa.int64()])
                number += 1

    return run


def _match(length: int, n_batches: int):
    reach = length - SEED

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        out = [(r["chunk"], r["ids"], r["text"], r["runs"]) for r in rows if r["ids"] is not None]
        sent = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["chunk"])
        if sent:
            size = np.array([len(r["doc"]) // 4 for r in sent])
            wide = np.concatenate([np.frombuffer(zstandard.decompress(r["bytes"]), np.uint8).reshape(-1, length + reach + 2) for r in sent])
            chunk = np.repeat(np.arange(len(sent)), size)
            doc, at = np.concatenate([np.frombuffer(r["doc"], np.uint32) for r in sent]), np.concatenate([np.frombuffer(r["at"], np.uint32) for r in sent]).astype(np.int64)
            _, first, inverse, n = np.unique(wide.view(f"S{wide.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
            w = wide[first]
            del wide
            family = SuffixFamily(np.ascontiguousarray(w[:, :length]), w[:, -2].astype(np.int64), np.ascontiguousarray(w[:, length:-2]), w[:, -1].astype(np.int64))
            family.cover(np.flatnonzero(n > 1))
            batch = (chunk[first] * n_batches) // len(sent)
            for k in range(n_batches):
                family.add(np.flatnonzero(batch == k))
            hit = (family.most >= family.least)[inverse]
            start, stop = at - family.most[inverse], at - family.least[inverse] + length
            for k, (lo, hi) in enumerate(zip(np.cumsum(size) - size, np.cumsum(size), strict=True)):
                mine = np.flatnonzero(hit[lo:hi]) + lo
                if len(mine):
                    out.append((sent[k]["chunk"], None, None, np.stack([doc[mine].astype(np.int64), start[mine], stop[mine]]).astype(np.int32).tobytes()))
        return pa.Table.from_batches([_binary_batch(out, ["chunk", "ids", "text", "runs"], [pa.int64()])])

    return run


def _runs_of_documents(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids, text = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["text"], np.int64)
    doc, start, stop = np.concatenate([np.frombuffer(r["runs"], np.int32).reshape(3, -1) for r in rows], 1).astype(np.int64)
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    reach = np.maximum.accumulate(stop + (doc << 32)) - (doc << 32) if len(doc) else stop
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])) if len(doc) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(doc)) - 1
    docs, n = np.unique(doc[begin], return_counts=True)
    cut = pa.array(np.append(0, np.cumsum(n)), pa.int32())
    return pa.table([pa.array(ids[docs]), pa.array(text[docs]), pa.ListArray.from_arrays(cut, pa.array(start[begin], pa.int32())), pa.ListArray.from_arrays(cut, pa.array(reach[end] if len(doc) else stop, pa.int32()))], names=["__id", "__hash", "starts", "stops"])


def repeated_runs(docs: DataFrame, length: int = 200, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hot_suffixes: int = 20_000) -> DataFrame:
    """(__id, __hash, starts, stops): the maximal byte runs covered by repeats, for each document that has any."""
    if length <= SEED or length > 255:
        raise ValueError(f"length must be from {SEED + 1} to 255")
    buckets, size = bucket_count(docs, text_col)
    hot_suffixes = max(hot_suffixes, size // 80_000_000)  # one byte in about 80 is an anchor, so about a million seeds are hot at most
    rows = keyed(docs.select(F.col(id_col), F.col(text_col).alias("__text")), id_col, "__text").select("__id", "__hash", "__text")
    long_rows = rows.filter(F.octet_length("__text") >= length)
    seeds = long_rows.mapInArrow(_send_seeds(buckets, length, chunk_bytes), "bucket int, chunk long, ids binary, first binary, text binary, h binary, at binary")
    answers = materialize(seeds.groupBy("bucket").applyInArrow(_answer_seeds(hot_suffixes), "chunk long, ids binary, first binary, text binary, at binary"), "seed-answers")
    hot = np.unique(np.frombuffer(b"".join(bytes(r["ids"]) for r in answers.filter("chunk is null and octet_length(ids) > 0").select("ids").collect()), np.uint64))
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    found = answers.filter("chunk is not null").groupBy("chunk").applyInArrow(_anchors_of_documents, "__id long, __hash long, anchors array<int>")
    found = found.groupBy("__id", "__hash").agg(F.max("anchors").alias("anchors"))
    near = long_rows.join(found, ["__id", "__hash"]).select("__id", "__hash", "anchors", "__text")
    sent = near.mapInArrow(_send_surroundings(buckets, length, chunk_bytes, hot), "bucket int, chunk long, ids binary, text binary, doc binary, at binary, bytes binary, runs binary")
    matched = sent.groupBy("bucket").applyInArrow(_match(length, batches), "chunk long, ids binary, text binary, runs binary")
    runs = matched.groupBy("chunk").applyInArrow(_runs_of_documents, "__id long, __hash long, starts array<int>, stops array<int>")
    return runs.groupBy("__id", "__hash").agg(F.max(F.struct("starts", "stops")).alias("s")).select("__id", "__hash", "s.starts", "s.stops")


def remove_runs(docs: DataFrame, length: int = 200, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, **options) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_bytes``, the spans and the kept bytes."""
    runs = repeated_runs(docs, length, batches, id_col, text_col, **options)
    source = keyed(docs.select(id_col, F.col(text_col).alias("__text")), id_col, "__text").join(runs, ["__id", "__hash"], "left").select(id_col, "starts", "stops", "__text")
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(3))
            raw = memoryview(data)
            starts, stops = b.column(1), b.column(2)
            removed, spans, digest, kept = [], [], [], []
            for i in range(b.num_rows):
                text = raw[bounds[i] : bounds[i + 1]]
                h, at, gone, parts = hashlib.sha256(), 0, 0, []
                if starts[i].is_valid:
                    for s, e in zip(starts[i].as_py(), stops[i].as_py(), strict=True):
                        h.update(text[at:s])
                        parts.append(text[at:s])
                        at, gone = e, gone + e - s
                h.update(text[at:])
                parts.append(text[at:])
                removed.append(gone)
                spans.append(len(parts) - 1)
                digest.append(h.hexdigest())
                if with_bytes:
                    kept.append(b"".join(parts))
            columns = [b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), *([starts, stops, pa.array(kept, pa.binary())] if with_bytes else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["starts", "stops", "kept"] if with_bytes else [])])

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", starts array<int>, stops array<int>, kept binary" * with_bytes)
