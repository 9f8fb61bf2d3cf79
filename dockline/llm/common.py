"""Helpers shared by the operators: reading tables, storing intermediate rows,
running a Python function over Arrow batches."""
from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Lower-cases A-Z, keeps a-z, 0-9 and every byte of a non-ASCII character and
#: turns all else into spaces: what is left between spaces are the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text (runs of letters, digits and non-ASCII)."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


#: Bytes of a text that are words at a time.
CHUNK = 1 << 18


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, cut before spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = end if end >= 0 else len(data)
        yield data[at:end]
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where the
    session names none and runs in one process (tests and local runs).  On a
    cluster, where the others couldn't read such a folder, that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="dockline-llm-"))
    return sc.getCheckpointDir()


#: Rows of a stored table a file holds at least, when their number is known.
ROWS_A_FILE = 250_000


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, computed once and written to the shared folder; later jobs read
    those files, also after an executor is lost.  ``rows``: a bound on its rows,
    for narrow tables, so that a small one isn't written as very many files."""
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver does.  On a cluster
    without a shared code folder, pass the package with ``--py-files``."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Rows that are Python objects at a time, whatever the size of Arrow's batches.
SLICE = 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def over_batches(df: DataFrame, make: Callable[[], Callable[..., Sequence]], fields: str | T.StructType,
                 n_args: int, keep: int | None = None) -> DataFrame:
    """Rows of ``df`` with Python results, Arrow batch by batch.

    ``make()`` runs once a task and returns ``f(*lists)``, which gets the first
    ``n_args`` columns as Python lists and returns one sequence for each of
    ``fields``.  Output: the columns after those (all of them but for the
    arguments if ``keep`` is None, else the last ``keep``), then ``fields``.
    """
    ship(df.sparkSession)
    added = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    kept = df.columns[n_args:] if keep is None else df.columns[len(df.columns) - keep:]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    types = [_arrow(f.dataType) for f in added.fields]
    names = [f.name for f in schema.fields]
    at = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in slices(batches):
            out = f(*(b.column(i).to_pylist() for i in range(n_args)))
            cols = [b.column(i) for i in at] + [pa.array(v, t) for v, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def text_of(col: str):
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
