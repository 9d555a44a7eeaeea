"""Scans: dispatch on the file's kind, explicit schemas, record lines, discovery of results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("node_type", T.StringType()), T.StructField("is_kinase", T.IntegerType()), T.StructField("is_phosphatase", T.IntegerType()), T.StructField("protein_role", T.StringType())])
EDGES = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("confidence_score", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("n_common", T.IntegerType())])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """Parquet, CSV, or tab-separated text, plain or gzipped, by extension; ValueError for other kinds.

    With no schema all columns of text files are strings: casting is left to the caller, so no pass infers types.
    Excel workbooks (.xlsx) give their first sheet, with the option header for the number of the row that names the columns.
    """
    name = PurePosixPath(path.rstrip("/")).name.lower()
    if name.endswith(".xlsx"):
        return read_sheet(spark, path, int(options.get("header", "0")))
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    stem = name.removesuffix(".gz")
    if stem.endswith(".csv") or (name.endswith(".gz") and ".csv" in path.lower()):
        sep = ","
    elif stem.endswith((".tsv", ".txt")) or name.endswith(".gz"):
        sep = "\t"
    else:
        raise ValueError(f"unsupported kind of file: {path}")
    reader = spark.read.options(**{"header": "true", "sep": sep, **options})
    return (reader.schema(schema) if schema else reader).csv(path)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab if the first line that isn't blank or a comment has more tabs than commas, else comma."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    first = lines.first()
    return "\t" if first and first.value.count("\t") > first.value.count(",") else ","


def read_headerless(spark: SparkSession, path: str, names: list[str], sep: str = "\t", comment: str = "#", skip: int = 0) -> DataFrame:
    """Text without a header, comment lines skipped, columns named by place; all strings. skip: so many first lines of a single file are no rows."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if not skip:
        return spark.read.options(sep=sep, comment=comment, header="false").schema(schema).csv(path)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = spark.read.text(path).select("value", (F.col("_metadata.file_block_start") == 0).alias("_first"), place.alias("_i"))
    kept = lines.where(~(F.col("_first") & (F.col("_i") < skip)) & ~F.col("value").startswith(comment) & (F.col("value") != ""))
    return kept.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep}).alias("r")).select("r.*")


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of the first sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        sheet = min((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        for number, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{MAIN}row")):
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                place = 0
                for letter in (x for x in c.get("r", "") if x.isalpha()):
                    place = place * 26 + ord(letter) - 64
                cells += [None] * (place - 1 - len(cells))
                value = c.find(f"{MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            yield int(row.get("r", number + 1)) - 1, cells


def read_sheet(spark: SparkSession, path: str, header: int = 0) -> DataFrame:
    """The first sheet of workbooks, all strings, blanks null; row number header (from 0) names the columns. A sheet has 2^20 rows at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = list(sheet_rows(content))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array([n for n, _ in part], pa.int64()), pa.array([c for _, c in part], pa.list_(pa.string()))], ["path", "n", "cells"])

    table = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, n long, cells array<string>")
    names = table.where(F.col("n") == header).orderBy("path").first()
    if names is None:
        raise ValueError(f"no row {header} in {path}")
    body = table.where(F.col("n") > header)
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names.cells) if n is not None])


def rename_by_place(df: DataFrame, names: list[str]) -> DataFrame:
    """The first len(names) columns, renamed."""
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=False)])


def read_line_records(spark: SparkSession, path: str, style: str = "blanks") -> DataFrame:
    """(grp, token) from lines of a group's name and its members.

    blanks: all separated by white space. tab_commas: name, tab, comma-separated members; lines that start with # are skipped.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if style == "blanks":
        parts = F.split(F.trim("value"), r"[\t\s]+")
        name, members = parts[0], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    elif style == "tab_commas":
        lines = lines.where(~F.trim("value").startswith("#") & F.col("value").contains("\t"))
        parts = F.split(F.trim("value"), "\t", 2)
        name, members = parts[0], F.split(parts[1], r"[,\t]")
    else:
        raise ValueError(f"unknown style: {style}")
    return lines.select(name.alias("grp"), F.explode(members).alias("token")).select("grp", F.trim("token").alias("token")).where("token <> ''")


def _checked(df: DataFrame, required: list[str], label: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks columns {missing}")
    return df


def load_graph(nodes: DataFrame, edges: DataFrame, label: str = "graph") -> tuple[DataFrame, DataFrame]:
    """Both tables with required columns checked and cast; flags default to 0."""
    n = _checked(nodes, NODES.fieldNames(), f"{label} nodes")
    e = _checked(edges, ["source", "target", "relation"], f"{label} edges")
    flags = [F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in ("is_kinase", "is_phosphatase")]
    metrics = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in EDGES.fields[3:] if f.name in e.columns]
    keys = [F.col(c).cast("string").alias(c) for c in ("source", "target", "relation")]
    return n.select(F.col("node_id").cast("string").alias("node_id"), F.col("node_type").cast("string").alias("node_type"), *flags, F.col("protein_role").cast("string").alias("protein_role")), e.select(*keys, *metrics)


def find_results(spark: SparkSession, root: str, keyword: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet results below root whose path holds the keyword, with their path; other files are listed and not scanned.

    A file with the schema is opened, and any file will do, unless the schema is given. No match gives no rows.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    found = (reader.schema(schema) if schema else reader).parquet(root)
    path = F.col("_metadata.file_path")  # a filter on it is applied to the list of files
    return found.where(path.contains(keyword)).withColumn("path", path)
