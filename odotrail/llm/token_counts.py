"""Token counts of byte-level BPE by rank-synchronous merging of arrays.

A block of texts is cut into pre-tokens by array operations on its characters (``starts``). Equal pre-tokens are one sequence,
and all sequences lie in one flat array of symbols with the bounds of each (a ragged array). A round finds the lowest rank
among the pairs of every sequence and merges that pair at all its places, in all sequences at once; sequences without a
mergeable pair leave. What is left are the tokens, of which only the number is kept. Merging a pair everywhere at once
is right as no later merge makes a pair of lower rank; vocabularies in which one could are refused. Of a pair of one symbol
with itself, overlapping places are merged from the left.

Sequences of more than ``LONG`` symbols (a run of letters without blanks) would be gone through once a merge. They go by rank
instead: all places of the lowest rank among all of them are merged in one step, found through lists of places by rank, so that
a step costs what it merges.

What is a letter, number or white space is what the installed library takes for it: each character that occurs is tried out
on the library's pre-tokeniser once a process.

Cases: a null text counts as empty, and has no tokens. A special string in a text is its one token, as by the library's default.
Texts that are not valid UTF-8 count as Spark's ``make_valid_utf8`` gives them. Very long texts are worked on in pieces cut before
blanks. Repeated rows and null ids give one row each; an empty table gives an empty result. Columns not in ``keep`` are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, code_points, distinct_slices, gather, mix64, utf8

#: Sequences of more symbols are merged rank by rank.
LONG = 256
#: Bytes of text that are worked on at once; a longer text is cut before blanks into pieces of about that size.
BLOCK_BYTES = 2 << 20
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
NONE = np.int32(2**31 - 1)
_loaded: dict[str, ByteLevelBpe] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others by 256, 257, ..."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairTable:
    """Pairs of symbols -> rank, by a hash table with open addresses."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        rank, slot, self.probes = np.arange(len(keys), dtype=np.int32), self.slots(keys), 0
        while len(rank):
            free = np.flatnonzero(self.keys[slot] == -1)
            slots, first = np.unique(slot[free], return_index=True)
            self.keys[slots], self.ranks[slots] = keys[free[first]], rank[free[first]]
            rest = np.ones(len(rank), bool)
            rest[free[first]] = False
            keys, rank, slot = keys[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``NONE``."""
        slot, out = self.slots(keys), np.full(len(keys), NONE, np.int32)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NONE)
        left = np.flatnonzero((there != keys) & (there != -1))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


class ByteLevelBpe:
    """The model of a tokeniser's JSON file: byte-level BPE with the usual splitting, no normaliser, no spaces added."""

    def __init__(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE with the usual splitting and without a normaliser is counted")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what is around them are not counted")
        #: Longer ones first: of those that begin at one place the library takes the longest.
        self.special = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        vocabulary = model["vocab"]
        self.byte_ids = np.array([vocabulary[c] for c in byte_symbols()], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(vocabulary)
        left, right = (np.array([vocabulary[m[k]] for m in merges], np.int64).reshape(-1) for k in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32).reshape(-1)
        rank_of = np.full(max(vocabulary.values()) + 1, NONE, np.int32)
        rank_of[self.byte_ids] = -1
        np.minimum.at(rank_of, self.made, np.arange(len(merges), dtype=np.int32))
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(merges))).any() or len(np.unique(left * len(rank_of) + right)) < len(merges):
            raise ValueError("a merge comes before those that make its parts, or twice")
        self.wide = len(rank_of)
        self.pairs = PairTable(left * self.wide + right)
        self.kinds = np.zeros(0x110000, np.uint8)

    @staticmethod
    def load(path: str) -> ByteLevelBpe:
        """Kept per worker process."""
        if path not in _loaded:
            with open(path, encoding="utf-8") as f:
                _loaded[path] = ByteLevelBpe(json.load(f))
        return _loaded[path]

    def classes(self, characters: np.ndarray) -> np.ndarray:
        """LETTER, NUMBER, OTHER or SPACE, by whether the library keeps the character with one of that kind."""
        out = self.kinds[characters]
        if len(out) and not out.all():
            from tokenizers.pre_tokenizers import ByteLevel

            split = ByteLevel(add_prefix_space=False).pre_tokenize_str
            for c in np.unique(characters[out == 0]).tolist():
                joined = (k for k, like in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(like + chr(c))) == 1)
                self.kinds[c] = next(joined, SPACE)
            out = self.kinds[characters]
        return out

    def starts(self, characters: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character; ``fresh``: whether a text does.

        The same as matching 's|'t|'re|'ve|'m|'ll|'d, runs of letters, of numbers and of other signs (each with a blank before it), and white space but
        for the last one before something else."""
        n = len(characters)
        if not n:
            return np.zeros(0, bool)
        kind = self.classes(characters)
        run = fresh.copy()
        run[1:] |= kind[1:] != kind[:-1]
        out = run.copy()
        after = np.flatnonzero(run & ~fresh & (kind != SPACE))
        after = after[kind[after - 1] == SPACE]
        out[after - 1] = True
        out[after[characters[after - 1] == 32]] = False
        # contractions: an apostrophe alone, not with a blank, before letters
        ends = np.append(fresh, [True] * 4)
        text = np.append(characters, np.zeros(4, characters.dtype))
        at = np.flatnonzero((characters == 39) & run & out)
        at = at[~ends[at + 1]]
        one = np.isin(text[at + 1], [ord(c) for c in "stmd"])
        pair = text[at + 1].astype(np.int64) << 21 | text[at + 2]
        two = np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")]) & ~ends[at + 2]
        for places, length in ((at[one], 2), (at[two], 3)):
            out[places + 1] = False
            stop = places + length
            out[stop[stop < n]] = True
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.find(left.astype(np.int64) * self.wide + right)

    def surviving(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of tokens of each sequence of symbols; none is empty."""
        size = np.diff(bounds)
        out = size.copy()
        long = size > LONG
        if long.any():
            out[long] = self._by_rank(symbols[gather(bounds[:-1][long], size[long])], np.append(0, np.cumsum(size[long])))
            symbols, size = symbols[np.repeat(~long, size)], size[~long]
        name = np.flatnonzero(~long)
        starts = np.cumsum(size) - size
        rank = np.full(len(symbols), NONE, np.int32)
        inner = np.ones(len(symbols), bool)  # has a next symbol in its sequence
        inner[starts + size - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(name):
            best = np.minimum.reduceat(rank, starts)
            live = best != NONE
            if not live.all():
                out[name[~live]] = size[~live]
                stay = np.repeat(live, size)
                symbols, rank = symbols[stay], rank[stay]
                name, size, best = name[live], size[live], best[live]
                starts = np.cumsum(size) - size
                if not len(name):
                    break
            owner = np.repeat(np.arange(len(name)), size)
            at = _apart(np.flatnonzero(rank == best[owner]))
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            merged = at - np.arange(len(at))  # where they are once the others are gone
            symbols, rank, owner = symbols[keep], rank[keep], owner[keep]
            size = np.bincount(owner, minlength=len(name))
            starts = np.cumsum(size) - size
            changed = np.zeros(len(symbols), bool)
            changed[merged] = changed[merged[merged > 0] - 1] = True
            near = np.flatnonzero(changed)
            inside = np.zeros(len(near), bool)
            inside[near + 1 < len(symbols)] = owner[near[near + 1 < len(symbols)]] == owner[near[near + 1 < len(symbols)] + 1]
            rank[near[~inside]] = NONE
            near = near[inside]
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
        return out

    def _by_rank(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``surviving`` of long sequences."""
        n = len(symbols)
        symbols, left, right = np.append(symbols, 0), np.arange(-1, n), np.arange(1, n + 2)
        here, last = np.ones(n + 1, bool), np.zeros(n + 1, bool)
        last[bounds[1:] - 1] = True
        last[n] = True
        rank = np.full(n + 1, NONE, np.int32)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def rate(at: np.ndarray) -> None:
            rank[at] = NONE
            at = at[~last[at]]
            found = self.ranks(symbols[at], symbols[right[at]])
            rank[at] = found
            at, found = at[found != NONE], found[found != NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cut = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
            for r, part in zip(found[cut].tolist(), np.split(at, cut[1:]), strict=True) if len(cut) else ():
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        rate(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[here[at] & (rank[at] == r)]
            # places of a pair of one symbol with itself may overlap: the next place is the right half of this one
            if len(at) > 1:
                follows = np.append(False, right[at[:-1]] == at[1:])
                if follows.any():
                    number = np.arange(len(at))
                    at = at[(number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0]
            if not len(at):
                continue
            gone = right[at]
            here[gone], rank[gone] = False, NONE
            symbols[at] = self.made[r]
            last[at] |= last[gone]
            right[at] = right[gone]
            left[right[at]] = at
            before = left[at]
            before = before[before >= 0]
            rate(np.unique(np.concatenate([at, before])))
        return np.add.reduceat(here[:n].astype(np.int64), bounds[:-1])

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text (row) of valid UTF-8."""
        rows = len(bounds) - 1
        out = np.zeros(rows, np.int64)
        cuts, special = self._specials(data, bounds)
        np.add.at(out, np.searchsorted(bounds, special, "right") - 1, 1)
        characters, ends = code_points(data, cuts)
        fresh = np.zeros(len(characters) + 1, bool)
        fresh[ends[:-1]] = True
        start = np.flatnonzero(self.starts(characters, fresh[:-1]))
        if not len(start):
            return out
        offset = np.flatnonzero((data & 0xC0) != 0x80) if len(characters) < len(data) else np.arange(len(data))
        begin = offset[start]
        end = np.append(begin[1:], len(data))
        ordinary = np.ones(len(begin), bool)
        if len(special):
            ordinary[:] = ~np.isin(cuts[np.searchsorted(cuts, begin, "right") - 1], special)
            begin, end = begin[ordinary], end[ordinary]
        first, of = distinct_slices(data, begin, end)
        size = end[first] - begin[first]
        sequences = self.byte_ids[data[gather(begin[first], size)]]
        tokens = self.surviving(sequences, np.append(0, np.cumsum(size)))[of] if len(first) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(tokens))
        return out + np.diff(total[np.searchsorted(begin, bounds)])

    def _specials(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bounds of texts and of the special strings in them, where special strings begin), first ones first."""
        found: list[tuple[int, int]] = []
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                found.append((at, at + len(s)))
                at = raw.find(s, at + 1)
        if not found:
            return bounds, np.zeros(0, np.int64)
        taken, end = [], 0
        for a, b in sorted(found, key=lambda p: (p[0], -p[1])):
            row = int(np.searchsorted(bounds, a, "right")) - 1
            if a >= end and b <= bounds[row + 1]:
                taken.append((a, b))
                end = b
        spans = np.array(taken, np.int64).reshape(-1, 2)
        return np.unique(np.concatenate([bounds, spans.ravel()])), spans[:, 0]


def _apart(at: np.ndarray) -> np.ndarray:
    """Without every second place of a run of neighbours, from its left end."""
    if len(at) < 2:
        return at
    number = np.arange(len(at))
    begin = np.append(True, at[1:] != at[:-1] + 1)
    return at[(number - np.maximum.accumulate(np.where(begin, number, 0))) % 2 == 0]


def pieces(data: np.ndarray, size: int) -> np.ndarray:
    """Bounds of pieces of one text: it is cut before a blank that follows an ASCII sign, at the first such place after every ``size`` bytes."""
    cuts = [0]
    while len(data) - cuts[-1] > size:
        rest = data[cuts[-1] + size :]
        after = np.flatnonzero((rest[1:] == 32) & (rest[:-1] > 32) & (rest[:-1] < 127))
        if not len(after):
            break
        cuts.append(cuts[-1] + size + int(after[0]) + 1)
    return np.array([*cuts, len(data)])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""
    source = docs.select(id_col, *keep, F.make_valid_utf8(F.col(text_col)).alias("__text"))
    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteLevelBpe.load(path)
        for b in batches:
            data, bounds = utf8(b.column(b.num_columns - 1))
            tokens = np.zeros(b.num_rows, np.int64)
            for i, j in blocks(bounds, BLOCK_BYTES):
                part = data[bounds[i] : bounds[j]]
                if j > i + 1 or len(part) <= BLOCK_BYTES:
                    tokens[i:j] = model.count(part, bounds[i : j + 1] - bounds[i])
                else:
                    cuts = pieces(part, BLOCK_BYTES)
                    tokens[i] = sum(int(model.count(part[s:e], np.array([0, e - s]))[0]) for s, e in zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(bounds)), pa.array(tokens), pa.array(tokens > limit)], names=[*b.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"{head}, n_bytes long, n_tokens long, over_limit boolean")
