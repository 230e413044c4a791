"""Substring removal: Rabin-Karp hashes of every window of ``window`` words, counted in Spark.

1. Tasks read documents in chunks of bounded size, hash every window from prefix sums, and deal the hashes
   to buckets as packed arrays. Within a chunk only the windows of the smallest id that holds them are sent;
   later ones are already known to repeat. A window common to many documents therefore travels once a chunk.
2. Each bucket sorts its hashes and answers every chunk with the windows that a smaller id also holds.
3. Each chunk merges its repeated windows into maximal intervals of words for each document.
4. The intervals are joined to the documents, whose words are then removed.

Two windows count as equal if 64 bits of one polynomial hash, 8 bits of a second one and their buckets, which other
bits of the second one choose, agree. The two start from different keyed hashes of the words, and the keys are drawn anew for each run, so
no text can be made to collide. Words are not compared again: with windows of 10**13 words in all (about 100 TB, over 2**19 buckets), that makes
0.02 false equalities among all pairs on average; at 30 GB about 10**-5.

The number of buckets grows with the bytes of text (``BUCKET_BYTES``), so a bucket does not. A chunk sends one row a
bucket at most, and never more than one a window.

Cases: a null text has no words; texts with fewer words than a window lose nothing. Rows with one id (ties) do not
remove each other's words; a null id counts as larger than all others. Repeated rows give repeated results. An empty
table gives no rows. Extra columns are only carried if asked for, and ignored otherwise, whatever their names. Texts that are not
valid UTF-8 count as Spark's ``make_valid_utf8`` gives them.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, SECOND_BASE, PolyHash, blocks, mix64, utf8, word_hashes, words

#: Windows (about as many as words) of a chunk; a longer document is a chunk alone.
CHUNK_WINDOWS = 1_500_000
#: Bytes of text whose windows (or anchors) share a bucket, on average.
BUCKET_BYTES = 16 << 20
NULL_ID = (1 << 63) - 1
#: bucket; chunk; ids: sorted document keys; first: first word of each document in the chunk's numbering;
#: h: window hashes of 8 bytes, then as many of 1 byte; at: their words (differences); text: the documents' text hashes; repeats: known repeats.
PACKED = "bucket int, chunk long, ids binary, first binary, h binary, at binary, text binary, repeats binary"


def bucket_count(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(number of buckets for the texts of ``docs``, their bytes); there are as many as shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)), size


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __id (null: the largest) and __hash (of the text), which together name a text's row."""
    return docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__hash": F.xxhash64(F.coalesce(text_col, F.lit("")))})


def window_hashes(data: np.ndarray, bounds: np.ndarray, window: int, keys: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words at which a whole window starts, two independent hashes of it, first word of each row)."""
    starts, hashes, seconds, counts = [], [], [], [np.zeros(1, np.int64)]
    done = 0
    for i, j in blocks(bounds):
        part, cut = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        start, end, first = words(part, cut)
        at = np.arange(len(start))
        at = at[at + window <= first[np.searchsorted(first, at, "right")]] if len(at) else at
        starts.append(at + done)
        for out, key, base in zip((hashes, seconds), keys, (BASE, SECOND_BASE), strict=True):
            out.append(mix64(PolyHash(word_hashes(part, start, end, key), base).slices(at, at + window)))
        counts.append(np.diff(first))
        done += len(start)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(starts, np.int64), join(hashes, np.uint64), join(seconds, np.uint64), np.cumsum(np.concatenate(counts))


def sorted_classes(h: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by both hashes, where a new pair of them begins)."""
    order = np.argsort(h, kind="stable")
    x, y = h[order], second[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((second, h))
        x, y = h[order], second[order]
    return order, np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(h) else np.zeros(0, bool)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (__id, __hash, text), cut into chunks of about ``size`` bytes: (number, ids, text hashes, data, bounds), sorted by id."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held, held_bytes = [], 0

    def flush():
        t = pa.Table.from_batches(held).combine_chunks().sort_by("__id").combine_chunks()
        data, bounds = utf8(t.column(2).chunk(0))
        return t.column(0).to_numpy(), t.column(1).to_numpy(), data, bounds

    for b in batches:
        _, bounds = utf8(b.column(2))
        for i, j in blocks(bounds, size):
            n = bounds[j] - bounds[i]
            if held and held_bytes + n > size:
                yield (number, *flush())
                number, held, held_bytes = number + 1, [], 0
            held.append(b.slice(i, j - i))
            held_bytes += n
    if held:
        yield (number, *flush())


def pack_deltas(at: np.ndarray) -> bytes:
    """Increasing numbers as differences of two bytes each, or of four where needed."""
    d = np.diff(at, prepend=0)
    wide = bool(len(d)) and int(d.max()) > 65535
    return bytes([wide]) + d.astype(np.uint32 if wide else np.uint16).tobytes()


def unpack_deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint32 if raw[0] else np.uint16, offset=1).astype(np.int64))


def _send(buckets: int, window: int, chunk_bytes: int, keys: tuple[int, int]):
    names = [f.split()[0] for f in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, text, data, bounds in chunks(batches, chunk_bytes):
            at, h, second, first = window_hashes(data, bounds, window, keys)
            row = np.searchsorted(first, at, "right") - 1
            order, fresh = sorted_classes(h, second)  # rows are sorted by id, so each class's smallest id comes first
            owner = ids[row[order]]
            smallest = owner[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(h) else owner
            known = np.zeros(len(h), bool)
            known[order] = owner > smallest
            del order, owner, fresh, smallest
            repeats = pack_deltas(at[known])
            h, second, at, row = h[~known], second[~known], at[~known], row[~known]
            bucket = ((second >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, second, at, row = h[order], second[order].astype(np.uint8), at[order], row[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(int(number % buckets), number, ids.tobytes(), first.tobytes(), None, None, text.tobytes(), repeats)]
            for k in np.flatnonzero(np.diff(cut)).tolist():
                lo, hi = cut[k], cut[k + 1]
                docs, n = np.unique(row[lo:hi], return_counts=True)
                out.append((k, number, ids[docs].tobytes(), n.astype(np.uint32).tobytes(), h[lo:hi].tobytes() + second[lo:hi].tobytes(), pack_deltas(at[lo:hi]), None, None))
                if len(out) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], names=names)

    return run


ANSWER = "chunk long, ids binary, first binary, text binary, repeats binary"


def _answer(group: pa.Table) -> pa.Table:
    """One bucket: passes the chunks' own rows on, and tells each chunk which of its windows a smaller id holds."""
    out = []
    sent = []
    for r in group.to_pylist():
        (out if r["h"] is None else sent).append((r["chunk"], r["ids"], r["first"], r["text"], r["repeats"]) if r["h"] is None else r)
    if sent:
        size = [len(r["h"]) // 9 for r in sent]
        h = np.concatenate([np.frombuffer(r["h"], np.uint64, n) for r, n in zip(sent, size, strict=True)])
        second = np.concatenate([np.frombuffer(r["h"], np.uint8, n, 8 * n) for r, n in zip(sent, size, strict=True)])
        owner = np.concatenate([np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["first"], np.uint32)) for r in sent])
        order, fresh = sorted_classes(h, second)
        begin = np.flatnonzero(fresh)
        del h, second, fresh
        owner_sorted = owner[order]
        smallest = np.repeat(np.minimum.reduceat(owner_sorted, begin), np.diff(np.append(begin, len(owner))))
        known = np.zeros(len(owner), bool)
        known[order] = owner_sorted > smallest
        for r, n, e in zip(sent, size, np.cumsum(size), strict=True):
            mine = known[e - n : e]
            if mine.any():
                out.append((r["chunk"], None, None, None, pack_deltas(unpack_deltas(r["at"])[mine])))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["chunk", "ids", "first", "text", "repeats"])


def _merge(window: int):
    def run(group: pa.Table) -> pa.Table:
        """One chunk: the maximal intervals of words to remove, for each of its documents that has any."""
        rows = group.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        ids, first, text = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["first"], np.int64), np.frombuffer(head["text"], np.int64)
        at = np.sort(np.concatenate([unpack_deltas(r["repeats"]) for r in rows]))
        row = np.searchsorted(first, at, "right") - 1
        fresh = np.append(True, (at[1:] > at[:-1] + window) | (row[1:] != row[:-1])) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(at))[: len(begin)] - 1
        doc = row[begin] if len(at) else np.zeros(0, np.int64)
        start, stop = at[begin] - first[doc], at[end] + window - first[doc]
        docs, n = np.unique(doc, return_counts=True)
        cut = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        return pa.table([pa.array(ids[docs]), pa.array(text[docs]), pa.ListArray.from_arrays(cut, pa.array(start, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(stop, pa.int32()))], names=["__id", "__hash", "starts", "stops"])

    return run


def repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 6 * CHUNK_WINDOWS) -> DataFrame:
    """(__id, __hash, starts, stops): the word intervals to remove, for each document that has any. See ``keyed``."""
    buckets, _ = bucket_count(docs, text_col)
    rows = keyed(docs.select(F.col(id_col), F.make_valid_utf8(F.col(text_col)).alias(text_col)), id_col, text_col).select("__id", "__hash", text_col)
    keys = secrets.randbits(64), secrets.randbits(64)
    sent = rows.mapInArrow(_send(buckets, window, chunk_bytes, keys), PACKED)
    answers = sent.groupBy("bucket").applyInArrow(_answer, ANSWER)
    found = answers.groupBy("chunk").applyInArrow(_merge(window), "__id long, __hash long, starts array<int>, stops array<int>")
    # rows that agree in id and text have the same intervals
    return found.groupBy("__id", "__hash").agg(F.max(F.struct("starts", "stops")).alias("s")).select("__id", "__hash", "s.starts", "s.stops")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space) and, with ``with_text``, ``kept_text``: the text without the removed words, its white
    space otherwise as it was (unchanged if nothing is removed; null for null)."""
    spans = repeated_windows(docs, window, id_col, text_col)
    names = [id_col, *keep]
    source = keyed(docs.select(*names, F.make_valid_utf8(F.col(text_col)).alias("__text")), id_col, "__text").join(spans, ["__id", "__hash"], "left").select(*names, "starts", "stops", "__text")
    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(b.num_columns - 1))
            raw = memoryview(data)
            starts, stops, null = b.column(b.num_columns - 3), b.column(b.num_columns - 2), b.column(b.num_columns - 1).is_null().to_pylist()
            n, removed, digest, kept = [], [], [], []
            for i in range(b.num_rows):
                text = bytes(raw[bounds[i] : bounds[i + 1]])
                tokens = text.split()
                n.append(len(tokens))
                cut = list(zip(starts[i].as_py(), stops[i].as_py(), strict=True)) if starts[i].is_valid else []
                removed.append(sum(e - s for s, e in cut))
                if with_text:
                    kept.append(None if null[i] else _without(text, cut) if cut else text)
                for s, e in reversed(cut):
                    del tokens[s:e]
                digest.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            columns = [*b.columns[: len(names)], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return source.mapInArrow(run, f"{head}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def _without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    """``text`` without the word intervals ``cut`` (and the white space that follows each removed word)."""
    start, end, _ = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    out, at = [], 0
    for s, e in cut:
        out.append(text[at : start[s]])
        at = int(start[e]) if e < len(start) else len(text)
    out.append(text[at:])
    joined = b"".join(out)
    return joined if cut[-1][1] < len(start) else joined.rstrip()
