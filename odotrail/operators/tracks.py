"""How operators that go through tracks in order are spread over tasks.

``deal`` cuts tracks of more than ``BLOCK_ROWS`` rows into blocks by time and deals tracks and blocks to pieces of bounded
size; a task works on one piece, with all its tracks side by side. Three ways to carry what went before into a block:

- ``scan``: operators whose effect over a block can be put in a few numbers (a map of states, a line, entry and end times).
  The blocks' effects are computed in parallel, chained track by track, and then the rows are filled in parallel.
- ``fold``: any other state. All tracks' first blocks run, then all second ones with the states that the first ones left, and so on. The
  rows are written by block first, so that each pass reads its own.
- Within a task, ``cut`` parts tracks once more, so that recurrences run over all parts at once, in as many steps as a part has rows.

Rows of one time are never parted: a time with very many rows makes a block of that size. Rows without a time come last. A null
track is a track like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import written

#: A longer track is cut into blocks of about this many rows; a piece has as many on average at most.
BLOCK_ROWS = 200_000
PIECE_ROWS = 100_000
#: Times are counted in this many parts a block, to cut where the rows are.
PARTS = 64
#: At most so many parts of long tracks are sent to all tasks; beyond, they are joined by shuffle.
BROADCAST_PARTS = 500_000


def typed(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns, which replace those of the same name."""
    extra = T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in columns.items()))
    return T.StructType([*[f for f in df.schema.fields if f.name not in columns], *extra.fields])


@dataclass
class Dealt:
    """rows: with __block (0, 1, ... in a track) and __piece; blocks: of the longest track."""

    rows: DataFrame
    blocks: int
    columns: list[str]
    track: str
    on: str
    row: str


def deal(df: DataFrame, track: str, on: str, row: str, block_rows: int | None = None) -> Dealt:
    block_rows = block_rows or BLOCK_ROWS
    t = F.col(on).cast("double")
    sizes = df.groupBy(track).agg(F.count("*").alias("__n"), F.min(F.when(~F.isnan(t), t)).alias("__lo"), F.max(F.when(~F.isnan(t), t)).alias("__hi"))
    whole = sizes.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("most"), F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.sum(F.when(F.col("__n") > block_rows, F.ceil(F.col("__n") / block_rows) * PARTS + 2)).alias("parts")).first()
    blocks, rows = 1, df.withColumn("__block", F.lit(0))
    if whole["most"] > block_rows:
        long = sizes.filter(F.col("__n") > block_rows).withColumnRenamed(track, "__long").withColumn("__parts", F.ceil(F.col("__n") / block_rows) * PARTS)
        small = (lambda x: F.broadcast(x)) if whole["parts"] <= BROADCAST_PARTS else (lambda x: x)
        share = (t - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
        part = F.when(F.col("__n").isNull(), None).when(t.isNull() | F.isnan(t), F.col("__parts") + 1).otherwise(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("__parts")))
        placed = df.join(small(long), F.col(track).eqNullSafe(F.col("__long")), "left").withColumn("__part", part).drop("__n", "__lo", "__hi", "__parts")
        counts = placed.filter("__part is not null").groupBy("__long", "__part").agg(F.count("*").alias("c"))
        w = Window.partitionBy("__long").orderBy("__part")
        before = counts.withColumn("__at", F.floor((F.sum("c").over(w) - F.col("c")) / block_rows)).withColumn("__number", (F.dense_rank().over(Window.partitionBy("__long").orderBy("__at")) - 1).cast("int"))
        before = written(before.select(F.col("__long").alias("__l"), F.col("__part").alias("__p"), "__number"), "track-blocks")
        blocks = (before.agg(F.max("__number")).first()[0] or 0) + 1
        rows = placed.join(small(before), F.col("__long").eqNullSafe(F.col("__l")) & (F.col("__part") == F.col("__p")), "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__number", F.lit(0)).alias("__block"))
    pieces = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole["rows"] // PIECE_ROWS))
    rows = rows.withColumn("__piece", F.pmod(F.xxhash64(F.col(track), "__block"), F.lit(pieces)))
    return Dealt(rows, blocks, df.columns, track, on, row)


def in_order(pdf: pd.DataFrame, d: Dealt | tuple[str, str, str]) -> tuple[pd.DataFrame, np.ndarray]:
    """(the rows of a piece in order, where each track's or block's begin). ``d``: track, time and row columns."""
    track, on, row = (d.track, d.on, d.row) if isinstance(d, Dealt) else d
    name = pd.factorize(pdf[track], use_na_sentinel=False)[0]
    block = pdf["__block"].to_numpy() if "__block" in pdf else np.zeros(len(pdf), np.int64)
    keys = pd.DataFrame({"name": name, "block": block, "t": pdf[on].to_numpy(), "row": pdf[row].to_numpy()})
    order = keys.sort_values(["name", "block", "t", "row"], kind="mergesort").index.to_numpy()
    name, block = name[order], block[order]
    return pdf.iloc[order], np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (block[1:] != block[:-1]))) if len(pdf) else np.zeros(0, np.int64)


def numbers(pdf: pd.DataFrame, *columns: str) -> np.ndarray:
    """Columns as doubles, with NaN for missing and infinite ones; a column that is not there is missing everywhere."""
    out = np.column_stack([pd.to_numeric(pdf[c], errors="coerce").to_numpy(float, na_value=np.nan) if c in pdf else np.full(len(pdf), np.nan) for c in columns])
    out[~np.isfinite(out)] = np.nan
    return out


def flags(pdf: pd.DataFrame, column: str) -> np.ndarray:
    """True where the column is; missing ones are false."""
    return np.array([x is True or x is np.True_ or (not isinstance(x, bool) and x == True) for x in pdf[column]], bool) if column in pdf else np.zeros(len(pdf), bool)  # noqa: E712


class Scan:
    """An operator for ``scan``. A block's effect and the state before and after it are lists of doubles; [] is the state at the start of a track."""

    def effects(self, pdf: pd.DataFrame, starts: np.ndarray) -> list[list[float]]:
        raise NotImplementedError

    def after(self, state: list[float], effect: list[float]) -> list[float]:
        raise NotImplementedError

    def chain(self, effects: list[list[float]]) -> Iterator[list[float]]:
        """The state before each block of one track."""
        state: list[float] = []
        for e in effects:
            yield state
            state = self.after(state, e)

    def fill(self, pdf: pd.DataFrame, starts: np.ndarray, states: list[list[float]]) -> pd.DataFrame:
        """The rows with the new columns (or some of the rows)."""
        raise NotImplementedError


def scan(df: DataFrame, op: Scan, track: str, on: str, row: str, columns: dict[str, str], block_rows: int | None = None) -> DataFrame:
    d = deal(df, track, on, row, block_rows)
    schema, names = typed(df, **columns) if columns else df.schema, [track, on, row]
    wanted = [f.name for f in schema]
    if d.blocks == 1:

        def alone(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, starts = in_order(pdf, names)
            return op.fill(pdf, starts, [[]] * len(starts))[wanted]

        return d.rows.groupBy("__piece").applyInPandas(alone, schema)
    kind = df.schema[track].dataType.simpleString()

    def effects(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts = in_order(pdf, names)
        return pd.DataFrame({"track": pdf[track].to_numpy()[starts], "block": pdf["__block"].to_numpy()[starts], "effect": op.effects(pdf, starts)})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"track": pdf["track"], "block": pdf["block"], "state": list(op.chain([list(e) for e in pdf["effect"]]))})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts = in_order(pdf, names)
        return op.fill(pdf, starts, [list(s) for s in pdf["__state"].iloc[starts]])[wanted]

    found = d.rows.groupBy("__piece").applyInPandas(effects, f"track {kind}, block int, effect array<double>")
    states = found.groupBy("track").applyInPandas(chain, f"track {kind}, block int, state array<double>")
    rows = d.rows.join(states, F.col(track).eqNullSafe(states.track) & (F.col("__block") == states.block)).select(*[F.col(f"`{c}`") for c in d.rows.columns], F.col("state").alias("__state"))
    return rows.groupBy("__piece").applyInPandas(fill, schema)


def side_by_side(starts: np.ndarray, n: int, state: np.ndarray, step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``step(states, rows) -> (states, outputs)`` with the first rows of all tracks, then the second ones, and so on: (last states, an output a row)."""
    size = np.diff(np.append(starts, n))
    order = np.argsort(-size, kind="stable")
    begin, state, out = starts[order], state[order].copy(), None
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # tracks with more rows than i
    for i, k in enumerate(live.tolist()):
        at = begin[:k] + i
        state[:k], found = step(state[:k], at)
        if out is None:
            out = np.full((n, found.shape[1]), np.nan)
        out[at] = found
    back = np.empty_like(state)
    back[order] = state
    return back, out


class Fold:
    """An operator for ``fold``: ``width`` numbers of state a track, NaN at its start."""

    width = 0

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(the new columns, the states after the rows)."""
        raise NotImplementedError


def fold(df: DataFrame, op: Fold, track: str, on: str, row: str, columns: dict[str, str], block_rows: int | None = None) -> DataFrame:
    return _folded(df, op, track, on, row, columns, block_rows).drop("__after")


def _folded(df: DataFrame, op: Fold, track: str, on: str, row: str, columns: dict[str, str], block_rows: int | None) -> DataFrame:
    """``fold``, with the state after a block in its last row's __after."""
    d = deal(df, track, on, row, block_rows)
    names, width = [track, on, row], op.width
    schema = T.StructType([*typed(df, **columns).fields, T.StructField("__after", T.ArrayType(T.DoubleType()))])
    wanted = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts = in_order(pdf, names)
        state = np.full((len(starts), width), np.nan)
        if "__state" in pdf:
            for k, s in enumerate(pdf["__state"].iloc[starts]):
                if s is not None:
                    state[k] = s
        found, state = op.run(pdf, starts, state)
        after = np.full(len(pdf), None, object)
        for k, last in enumerate(np.append(starts[1:], len(pdf)) - 1):
            after[last] = state[k]
        return pdf.assign(**found, __after=after)[wanted]

    if d.blocks == 1:
        return d.rows.groupBy("__piece").applyInPandas(run, schema)
    out, state, dealt = None, None, written(d.rows.repartition("__block", "__piece"), "track-rows", "__block")
    for b in range(d.blocks):  # each reads its own blocks alone
        rows = dealt.filter(F.col("__block") == b)
        if state is not None:
            rows = rows.join(state, F.col(track).eqNullSafe(F.col("__track")), "left").drop("__track")
        done = written(rows.groupBy("__piece").applyInPandas(run, schema), "track-fold")
        state = done.filter("__after is not null").select(F.col(track).alias("__track"), F.col("__after").alias("__state"))
        out = done if out is None else out.union(done)
    return out


def end_states(df: DataFrame, op: Fold, track: str, on: str, row: str, block_rows: int | None = None) -> DataFrame:
    """track and state: what ``op`` is in after each track's last row, for a stream that goes on from there."""
    out = _folded(df, op, track, on, row, {}, block_rows).filter("__after is not null").select(track, on, row, F.col("__after").alias("state"))
    return out.withColumn("__last", F.row_number().over(Window.partitionBy(track).orderBy(F.desc_nulls_first(on), F.desc(row)))).filter("__last = 1").select(track, "state")


def cut(starts: np.ndarray, n: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(where parts of tracks begin, the track of each): tracks cut into parts of at most ``length`` rows, about the root of ``n``."""
    length = length or max(16, int(np.sqrt(n)))
    size = np.diff(np.append(starts, n))
    parts = -(-size // length)
    of = np.repeat(np.arange(len(starts)), parts)
    return starts[of] + length * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)), of


def steps(begin: np.ndarray, n: int, state: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``side_by_side`` over parts, of states alone: the state after each part."""
    size = np.diff(np.append(begin, n))
    order = np.argsort(-size, kind="stable")
    first, now = begin[order], state[order].copy()
    for i, k in enumerate(np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left").tolist()):
        now[:k] = step(now[:k], first[:k] + i)
    out = np.empty_like(now)
    out[order] = now
    return out
