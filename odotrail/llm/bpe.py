"""Byte-level BPE encoding and decoding with a local rank file.

A long text is cut at safe boundaries, before a white space that follows something else: no match of the
splitting pattern crosses such a place, so the pieces' ids are the whole text's ids. A long run of white
space, on which the library's pattern engine would run out of stack, is one match of the pattern but for its
last character (all of it at the end of a text), and is encoded as that match. Decoding joins the tokens' raw
bytes.

Both hold for patterns that end in ``\\s+(?!\\S)|\\s+`` and else match at most one white space, a leading one.

Cases: a null text counts as empty and has no ids, and counts as decoded rightly. A text without a safe boundary
is encoded whole. Texts that are not valid UTF-8 count as Spark's ``make_valid_utf8`` gives them. Repeated rows and null ids give one row each; an empty table gives an empty result. Columns not
in ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer texts (in characters) are cut at safe boundaries, into pieces of about this size.
PIECE_CHARS = 1 << 15
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: Runs of this many white spaces (by Unicode's property) are encoded as matches of their own.
RUN_CHARS = 1 << 14
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN_CHARS)
_loaded: dict[str, tuple] = {}


def load(rank_path: str, pattern: str):
    """(encoding, decimal text of each id) of a rank file; kept per worker process."""
    if rank_path not in _loaded:
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[rank_path] = encoding, [str(i) for i in range(max(ranks.values()) + 1)]
    return _loaded[rank_path]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(encoding, text: str) -> list[int]:
    if len(text) < RUN_CHARS:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last white space of a run may begin the next match
        for p in pieces(text[at : run.start()]):
            ids += encoding.encode_ordinary(p)
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    for p in pieces(text[at:]):
        ids += encoding.encode_ordinary(p)
    return ids


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, n_tokens, ids_sha256 (of the decimal ids joined
    by commas), decoded_sha256 (of the decoded bytes), round_trip (the decoded bytes are the text's) and, with
    ``keep_ids``, the ids themselves."""
    source = docs.select(id_col, *keep, F.make_valid_utf8(F.col(text_col)).alias("__text"))
    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    schema = f"{head}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, decimal = load(rank_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # a few hundred texts at a time bound the lists of ids
                part = b.slice(at, 256)
                n, ids_hash, bytes_hash, same, kept = [], [], [], [], []
                for text in part.column(part.num_columns - 1):
                    text = text.as_py() or ""
                    ids = encode(encoding, text)
                    back = encoding.decode_bytes(ids)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    bytes_hash.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
                    if keep_ids:
                        kept.append(pa.array(ids, pa.int32()))
                columns = [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(bytes_hash), pa.array(same)]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * keep_ids])

    return source.mapInArrow(run, schema)
