"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, else one of our own.

    Only a local master (tests) gets a temporary folder; a cluster without the
    setting gets a folder under its warehouse.
    """
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        made = getattr(shared_dir, "made", None)
        if made is None or not os.path.isdir(made):
            made = shared_dir.made = tempfile.mkdtemp(prefix="duolith-")
        return f"file://{made}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"


#: Where the shared folder is a local path, Hadoop starts a process (chmod) for each folder, file and checksum file that it makes,
#: and while one starts it has all pages of the JVM a second time. These leave out the checksum files and the mark of success.
WITHOUT_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here."""
    spark = bounded(df).sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**WITHOUT_CHECKSUMS).option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rows:
    """Sparse rows in two growing buffers: whole blocks that go back to the system when they are let go."""

    def __init__(self) -> None:
        self.places, self.values, self.ends = array("i"), array("f"), [0]

    def add(self, places: np.ndarray, values: np.ndarray) -> None:
        self.places.frombytes(places.astype(np.int32).tobytes())
        self.values.frombytes(values.astype(np.float32).tobytes())
        self.ends.append(len(self.places))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[i], self.ends[i + 1]
        return np.frombuffer(self.places, np.int32, b - a, 4 * a), np.frombuffer(self.values, np.float32, b - a, 4 * a)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def digest_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def slices(texts: list, most_chars: int = 1 << 20):
    """Ranges of a list of texts that hold about most_chars each, to bound a Python step's memory."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > most_chars:
            yield at, i
            at, held = i, 0
        held += len(t or "")
    if at < len(texts):
        yield at, len(texts)


#: Bits of the filter below.
FILTER_BITS = 20


def membership(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test of hashes against the only column (bigint) of wanted: true for all of them, and for a share of the others.

    The filter has 2**FILTER_BITS bits. It enters a plan as a subquery of one row: as a
    constant, each description of the plan that the driver keeps would spell it out
    several times. It spares rows a shuffle before a join that decides. Where the values fill half of it, it
    would spare few and is left out: all rows pass, and joins of large tables have the
    runtime filters of Spark.
    """
    (name,) = wanted.columns
    bit = F.col(name).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = wanted.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("b"))
    held, full = np.zeros(1 << FILTER_BITS - 5, np.int64), 0
    for r in words.collect():  # at most 2**(FILTER_BITS - 5) rows
        held[r["w"]] = r["b"]
        full += r["b"].bit_count()
    if 2 * full > 1 << FILTER_BITS:
        return lambda h: F.lit(True)
    table_ = wanted.sparkSession.createDataFrame(pa.table({"b": pa.array([held], pa.list_(pa.int64()))})).scalar()

    def test(h: Column) -> Column:
        at = h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        word = F.get(table_, F.shiftright(at, 5).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(31)).cast("int"))) != 0

    return test


#: What goes to a Python worker at once: rows, and bytes where the rows are long.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Rows that a reader of Parquet decodes at once, and what a writer holds before it writes.
READ_ROWS, BLOCK_BYTES = 512, 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches and readers' batches are small enough for whole texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Memory that this process has let go of goes back to the system; an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in small batches; a worker that is done gives its memory back."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return bounded(df).mapInArrow(lean, schema)


def map_texts(df: DataFrame, make: Callable[[list[str]], dict[str, list]], schema: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Runs a Python step over whole texts, a bounded slice at a time.

    make gets a list of texts (null: empty) and returns columns; where it returns
    "_row", a row belongs to the text of that index, else there is a row for each
    text. The key passes through as it is. Other columns are not read.
    """
    want = StructType.fromDDL(f"{schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(want)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                made, keys = make(texts[a:b]), batch.column(0).slice(a, b - a)
                if "_row" in made:
                    keys = keys.take(pa.array(made["_row"], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(made[f.name], f.type) for f in types)], names=[key, *types.names])

    kind = dict(df.dtypes)[key]
    return map_batches(df.select(key, F.col(text).cast("string").alias("text")), run, f"`{key}` {kind}, {schema}")
