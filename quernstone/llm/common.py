"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

#: Text bytes that one step of a batch handles at once; bounds the memory of a Python worker. Batches themselves are
#: bounded by Spark (``spark.sql.execution.arrow.maxBytesPerBatch``).
STEP_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, as executors could not
    read each other's files.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quernstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that all executors share.

    Spark removes a checkpoint when nothing refers to it any more, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores over all cores.

    A single small file is one split; scans with enough splits are left alone, so large tables are never shuffled for
    this. Only for scans: counting the splits of anything else would run its shuffles.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan


def is_held_out(doc_id: str | Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1


def slices(column: pa.Array, most: int = STEP_BYTES):
    """Cut an Arrow column of text into runs of about ``most`` bytes; a longer text is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + n > most:
            yield start, column.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(column):
        yield start, column.slice(start)


def map_text(df: DataFrame, column: str, fields: StructType, factory, keep: list[str] | None = None, only: str | None = None) -> DataFrame:
    """Add result columns computed from a text column, one Arrow batch at a time.

    ``factory()`` is called once in each task and gives a function from an Arrow string
    array to a list of Arrow arrays, one for each field. ``keep`` names the input columns
    that are passed on (default: all). An input column with the name of a result column
    is replaced by the result. With ``only``, the name of a boolean result, the rows for which
    it is true are passed on as they were, without the results. Each text goes to Python once.
    Rows keep their partition; nothing is shuffled.
    """
    gone = set() if only else set(fields.names)
    passed = [f for f in df.schema.fields if f.name not in gone and (keep is None or f.name in keep)]
    sent = [F.col(f"`{f.name}`") for f in passed]
    at = next((i for i, f in enumerate(passed) if f.name == column and isinstance(f.dataType, StringType)), len(passed))
    if at == len(passed):
        sent.append(F.col(f"`{column}`").cast("string").alias("__text"))
    types = [to_arrow_type(f.dataType) for f in fields.fields]
    n, names, flag = len(passed), [f.name for f in passed], only and fields.names.index(only)

    def run(batches):
        work = factory()
        for batch in batches:
            for first, piece in slices(batch.column(at)):
                made, rest = work(piece), batch.slice(first, len(piece)).columns[:n]
                if only:
                    yield pa.RecordBatch.from_arrays(rest, names=names).filter(made[flag])
                else:
                    made = [m.cast(t) for m, t in zip(made, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, *fields.names])

    return df.select(*sent).mapInArrow(run, StructType(passed if only else [*passed, *fields.fields]))
