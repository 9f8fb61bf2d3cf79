"""Read raw text exports (CSV or Parquet) into the canonical schema.

Every cell is read as text (no inference).  All files of an export are read.
Files may have different headers: tasks read the first record of every CSV file,
in one job whatever the number of files, files with the same header row are read
in one scan, and the canonical frames are put one below the other.  Each row gets an
``ordinal`` that reproduces file order without a global sort:
``(file path, split start, position within the split)``.
"""
from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import spread
from .headers import COLUMNS, ExportSchemaError, HeaderMap

# Cell texts read as missing by default (the spreadsheet reader's
# default NA tokens).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null")
HEAD_BYTES = 1 << 16


def list_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The data files that paths, folders and globs stand for, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        for status in fs.globStatus(at) or []:
            inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += sorted(f.getPath().toString() for f in inner
                            if f.isFile() and f.getPath().getName()[:1] not in ("_", "."))
    if not found:
        raise ExportSchemaError(f"No files at {', '.join(paths)}.")
    return list(dict.fromkeys(found))


def read_header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """The first record of a CSV file, read by the driver; cells may be quoted and
    hold line breaks."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    size = HEAD_BYTES
    while True:
        stream = at.getFileSystem(conf).open(at)
        stream = codec.createInputStream(stream) if codec is not None else stream
        try:
            head = bytes(stream.readNBytes(size))
        finally:
            stream.close()
        text = head.decode(encoding, "replace").removeprefix("\ufeff")
        reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
        first = next((r for r in reader if r), [])
        whole = next(reader, None) is not None  # a second record begins: the first one is complete
        if whole or len(head) < size:
            return first
        size *= 4


#: Larger than any file: a task per file, whatever its size.
WHOLE_FILE = 1 << 50


@contextmanager
def one_file_a_task(spark: SparkSession):
    """Scans planned meanwhile put every file in a task of its own."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, str(WHOLE_FILE))
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def header_rows(spark: SparkSession, files: Sequence[str], sep: str, encoding: str) -> dict[str, list[str]]:
    """The first record of each CSV file, by file.

    One job reads them: a task takes lines of its file until a record is complete,
    and no more.  Files that it says nothing about (without lines, or in an encoding
    whose line ends are no single bytes) are looked at one by one."""
    found: dict[str, list[str]] = {}
    if "\n".encode(encoding) == b"\n":
        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path: list[str] = []

            def lines():
                for b in batches:
                    path[:] = path or [b.column(0)[0].as_py()]
                    for value in b.column(1).to_pylist():
                        yield value.decode(encoding, "replace").removeprefix("\ufeff") + "\n"
            if (row := next((r for r in csv.reader(lines(), delimiter=sep) if r), None)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array([row], pa.list_(pa.string()))],
                                                 names=["path", "header"])

        with one_file_a_task(spark):
            lines = spark.read.text(list(files)).select(F.col("_metadata.file_path").alias("path"),
                                                        F.col("value").cast("binary").alias("line"))
            rows = lines.mapInArrow(first, "path string, header array<string>").collect()  # a row a file
        found = {plain_path(r["path"]): r["header"] for r in rows}
    return {f: found[plain_path(f)] if plain_path(f) in found else read_header(spark, f, sep, encoding) for f in files}


def plain_path(path: str) -> str:
    """One spelling of a file's path, as listed or as a scan names it."""
    return unquote(path).replace(":///", ":/", 1)


def read_csv(spark: SparkSession, files: Sequence[str], headers: Sequence[str], sep: str, encoding: str,
             multiline: bool) -> DataFrame:
    """Cells ``_c0``.. of CSV files with one header row, and the ordinal.  Quotes
    inside quoted cells are doubled (RFC 4180)."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(headers))])
    broken = any("\n" in h or "\r" in h for h in headers)
    read = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep)
            .option("encoding", encoding).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline or broken))
    if broken:
        # The reader takes the first line end that it meets for that of the records, and this one
        # is inside a header: name it, and take the rest of another one off the last cell.
        read = read.option("lineSep", "\n")
    cells = read.csv(list(files))
    if broken:
        cells = cells.withColumn(cells.columns[-1], F.regexp_replace(cells.columns[-1], "\r$", ""))
    return cells.select("*", F.struct(F.col("_metadata.file_path").alias("k1"),
                                      F.col("_metadata.file_block_start").alias("k2"),
                                      F.monotonically_increasing_id().alias("k3")).alias("ordinal"))


def read_parquet(spark: SparkSession, files: Sequence[str]) -> tuple[DataFrame, list[str]]:
    table = spark.read.parquet(*files)
    cells = table.toDF(*(f"_c{i}" for i in range(len(table.columns))))
    ordinal = F.struct(F.col("_metadata.file_path").alias("k1"), F.col("_metadata.row_index").alias("k2"),
                       F.lit(0).cast("long").alias("k3"))
    return cells.select(*(cell_text(F.col(f.name), f.dataType).alias(f.name) for f in cells.schema),
                        ordinal.alias("ordinal")), table.columns


def cell_text(c: Column, kind: T.DataType) -> Column:
    """A typed cell as its text; floating numbers without an exponent, and whole
    ones without a fraction (an id stored as a double stays an id)."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast("string")
    whole = c.cast("decimal(38,0)").cast("string")
    part = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.when(c == F.floor(c), F.coalesce(whole, c.cast("string"))).otherwise(F.coalesce(part, c.cast("string")))


def canonical(cells: DataFrame, headers: HeaderMap, export_id: Column, null_tokens: Sequence[str]) -> DataFrame:
    """The 35 canonical text columns, ordinal and export_id from positional cells."""
    names = [c for c in cells.columns if c not in ("ordinal", "export_id")]
    rows = cells.select(*headers.columns([F.col(c) for c in names]), "ordinal", export_id.alias("export_id"))
    if not null_tokens:
        return rows
    return rows.select(*(F.when(~F.col(c).isin(*null_tokens), F.col(c)).alias(c) for c in COLUMNS),
                       "ordinal", "export_id")


def _tables(spark, paths, fmt, sep, encoding, multiline) -> list[tuple[HeaderMap, DataFrame, str]]:
    """(headers, cells, a file's name) for each distinct header row."""
    files = list_files(spark, [paths] if isinstance(paths, str) else list(paths))
    groups: dict[tuple, list[str]] = {}
    if fmt == "csv":
        for f, header in header_rows(spark, files, sep, encoding).items():
            groups.setdefault(tuple(header), []).append(f)
        if groups.pop((), None) and not groups:
            raise ExportSchemaError("The export is empty.")
        return [(HeaderMap(h), read_csv(spark, g, h, sep, encoding, multiline), g[0]) for h, g in groups.items()]
    for f in files:
        schema = spark.read.parquet(f).schema  # footer only
        groups.setdefault(tuple((x.name, x.dataType.simpleString()) for x in schema), []).append(f)
    tables = [(read_parquet(spark, g), g[0]) for g in groups.values()]
    return [(HeaderMap(h), cells, f) for (cells, h), f in tables]


def read_export(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv",
                export_id: str = "export", null_tokens: Sequence[str] = NULL_TOKENS,
                sep: str = ",", encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """A1: every file of an export, in the canonical schema.

    ``multiline``: cells may hold line breaks.  A file is then read by one task,
    so an export should be many files; pass False for huge files that are known
    to have no such cells.  A file without the required columns is an error."""
    out = None
    for headers, cells, name in _tables(spark, paths, fmt, sep, encoding, multiline):
        part = canonical(spread(cells), headers.require(name), F.lit(export_id), null_tokens)
        out = part if out is None else out.unionByName(part)
    return out


def pick_export(spark: SparkSession, candidates: Sequence[str], fmt: str = "csv", **options) -> DataFrame:
    """A2: of candidate tables that hold the same upload (the sheets of a workbook,
    say), the one with the most required columns; the first one wins ties."""
    if not candidates:
        raise ExportSchemaError("The export contains no tables.")
    look = {k: options.get(k, d) for k, d in (("sep", ","), ("encoding", "UTF-8"), ("multiline", True))}
    scores = [max(h.score for h, _, _ in _tables(spark, c, fmt, **look)) for c in candidates]
    return read_export(spark, candidates[scores.index(max(scores))], fmt, **options)


def from_rows(spark: SparkSession, headers: Sequence[str], rows: Sequence[Sequence],
              export_id: str = "export", null_tokens: Sequence[str] = ()) -> DataFrame:
    """A small literal export (tests, hand-entered uploads): text cells in
    ``rows`` under raw ``headers``; the ordinal is the row position."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(headers))]
                          + [T.StructField("_row", T.LongType())])
    data = [tuple(None if v is None else str(v) for v in r) + (i,) for i, r in enumerate(rows)]
    cells = spark.createDataFrame(data, schema)
    cells = cells.select(*(f"_c{i}" for i in range(len(headers))), F.struct(F.col("_row").alias("k1")).alias("ordinal"))
    return canonical(cells, HeaderMap(headers).require(), F.lit(export_id), null_tokens)


def from_table(table: DataFrame, null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """An export that is already a DataFrame: its column names are the raw headers;
    the last two columns are ``ordinal`` and ``export_id``."""
    headers, kinds = table.columns[:-2], [f.dataType for f in table.schema][:-2]
    cells = table.toDF(*(f"_c{i}" for i in range(len(headers))), "ordinal", "export_id")
    cells = cells.select(*(cell_text(F.col(f"_c{i}"), k).alias(f"_c{i}") for i, k in enumerate(kinds)), "ordinal", "export_id")
    return canonical(cells, HeaderMap(headers).require(), F.col("export_id"), null_tokens)
