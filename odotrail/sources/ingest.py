"""Reading drive logs, road files and split files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers, scalar

ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def scan_csv_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every *.csv below ``root``: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path", "length", "content")


def decode_with_fallback(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """(text, encoding): the first encoding that fits; the last one always does."""
    for e in encodings:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1"), "latin-1"


def inventory(files: DataFrame) -> DataFrame:
    """Files with sequence_id, kind by path, or by headers where the path does not tell, encoding, headers and number of rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                text, encoding = decode_with_fallback(bytes(raw))
                lines = csv.reader(io.StringIO(text))
                names = headers.unique_headers(headers.clean_headers(next(lines, [])))
                out.append((path, encoding, names, " ".join(headers.normalized(n) for n in names), sum(1 for r in lines if r)))
            yield pd.DataFrame(out, columns=["path", "encoding", "columns", "header_text", "rows"])

    found = files.mapInPandas(read, "path string, encoding string, columns array<string>, header_text string, rows long")
    by_path, by_columns = headers.classify_by_path(F.col("path")), headers.classify_by_columns(F.col("header_text"))
    return found.select("path", headers.extract_sequence_id(F.col("path")).alias("sequence_id"), F.when(by_path == "UNKNOWN", by_columns).otherwise(by_path).alias("kind"), "encoding", "columns", "rows")


def read_sv_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects): one row a sample with sequence_id, kind (by path, or by headers where the path does not tell), row_idx and its
    cells by header; and what could not be read, with the reason. A file is parsed by one task, line by line."""
    columns = ["path", "row_idx", "cells", "by_headers", "problem"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                out, names, kind = [], [], "UNKNOWN"
                try:
                    lines = csv.reader(io.StringIO(decode_with_fallback(bytes(raw))[0]), strict=True)
                    names = headers.unique_headers(headers.clean_headers(next(lines, [])))
                    n, kind = 0, headers.kind_of_headers(names)
                    for cells in lines:
                        if cells:
                            bad = f"{len(cells)} cells, {len(names)} headers" if len(cells) != len(names) else None
                            out.append((path, n, dict(zip(names, cells, strict=False)), kind, bad))
                            n += 1
                        if len(out) == 5000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                except csv.Error as e:
                    out.append((path, -1, {}, kind, str(e)))
                if not names:
                    out.append((path, -1, {}, kind, "no header"))
                yield pd.DataFrame(out, columns=columns)

    rows = files.mapInPandas(parse, "path string, row_idx long, cells map<string,string>, by_headers string, problem string")
    by_path = headers.classify_by_path(F.col("path"))
    kind = F.when(by_path == "UNKNOWN", F.col("by_headers")).otherwise(by_path)
    named = rows.select(headers.extract_sequence_id(F.col("path")).alias("sequence_id"), kind.alias("kind"), "path", "row_idx", "cells", "problem")
    return named.filter("problem is null").drop("problem"), named.filter("problem is not null").select("sequence_id", "path", "row_idx", "problem")


def canonical(samples: DataFrame, columns: list[str], prefix: str = "S_") -> DataFrame:
    """Samples (one kind) as a table: source columns with a prefix, and the canonical sensor columns as finite doubles."""
    wide = samples.select("sequence_id", "row_idx", *[F.col("cells")[c].alias(prefix + c) for c in columns])
    found = headers.resolve_columns([prefix + c for c in columns])
    return wide.withColumns({name: scalar.to_numeric(f"`{c}`", first_number=name == "gps_satellites") for name, c in found.items()})


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the columns wanted of a parquet table (that are there)."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


ROAD_SCHEMA = "nodes map<string, struct<lat: double, lon: double>>, ways array<struct<id: string, nodes: array<string>, tags: map<string, string>>>, elevation_m map<string, double>"
ELEMENT_SCHEMA = "elements array<struct<type: string, id: string, lat: double, lon: double, nodes: array<string>, tags: map<string, string>>>"


def read_road_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of road files, either with a map of nodes or with a list of typed elements. Corrupt files give no rows."""
    both = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(f"{ROAD_SCHEMA}, {ELEMENT_SCHEMA}").json(path)
    mapped = both.filter("nodes is not null")
    elements = both.select(F.explode("elements").alias("e"))
    heights = mapped.select(F.explode("elevation_m").alias("node_id", "elevation"))
    nodes = mapped.select(F.explode("nodes").alias("node_id", "n")).select("node_id", "n.lat", "n.lon")
    nodes = nodes.unionByName(elements.filter("e.type = 'node'").select(F.col("e.id").alias("node_id"), "e.lat", "e.lon"))
    ways = both.select(F.explode("ways").alias("w")).select(F.col("w.id").alias("way_id"), "w.nodes", "w.tags")
    ways = ways.unionByName(elements.filter("e.type = 'way'").select(F.col("e.id").alias("way_id"), "e.nodes", "e.tags"))
    return nodes.join(heights, "node_id", "left"), ways


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, split) of a JSON split file: lists of ids by split, or objects with sequences, sequence_ids or ids; upper or lower case."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    out = None
    for split in ("train", "validation", "test"):
        names = [split, split.upper(), split.capitalize(), *(["val", "VAL"] if split == "validation" else [])]
        lists = [F.from_json(F.get_json_object("v", f"$.{n}{suffix}"), "array<string>") for n in names for suffix in ("", ".sequences", ".sequence_ids", ".ids")]
        one = text.select(F.explode(F.coalesce(*[F.when(F.size(x) > 0, F.when(~F.exists(x, lambda i: i.isNull()), x)) for x in lists])).alias("name")).select(headers.normalize_sequence_id(F.col("name")).alias("sequence_id"), F.lit(split).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out


def sensor_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """Sensor states as they arrive as files; the schema must be given."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)
