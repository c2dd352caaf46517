"""Files as rows: uploads, manifests, logs and orphans. All listing and reading is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG = "id string, ts string, level string, message string, extra map<string,string>, __bad string"

# The first bytes of file types, in hexadecimal.
MAGIC = (("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("255044462D", "pdf"))
#: Limits of one upload: files, bytes of a file, bytes together.
UPLOAD_LIMITS = (24, 40 << 20, 200 << 20)


def upload_type(content: Column) -> Column:
    """jpeg, png, webp, pdf or heic by a file's first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for prefix, name in MAGIC:
        out = F.when(head.startswith(prefix), name) if out is None else out.when(head.startswith(prefix), name)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    heic = (F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("68656963", "68656978", "6D696631", "68657663")
    return out.when(webp, "webp").when(heic, "heic")


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row for each file: ``path, modificationTime, length, content``; unused content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of all files below a folder."""
    return read_files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files of each folder, from file metadata alone."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return read_files(spark, path).groupBy(folder.alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of an upload with type, digest and what is wrong with each: ``path, length, kind, sha256, problem``.

    The batch as a whole is judged by its running total in path order. Spark's reader passes over empty files, so those
    have no row and are never taken in.
    """
    most_files, most_bytes, most_total = UPLOAD_LIMITS
    files = read_files(spark, path).select("path", "length", upload_type(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))
    order = Window.partitionBy(F.regexp_replace("path", "/[^/]*$", "")).orderBy("path")  # one upload is one folder, of a few dozen files
    problem = (
        F.when(F.col("length") > most_bytes, "too_large")
        .when(F.col("kind").isNull(), "unknown_type")
        .when(F.row_number().over(order) > most_files, "too_many")
        .when(F.sum("length").over(order) > most_total, "total_too_large")
    )
    return files.select("path", "length", "kind", "sha256", problem.alias("problem"))


def orphans(spark: SparkSession, path: str, referenced: DataFrame, column: str, older_than: Column) -> DataFrame:
    """Files that no row refers to and that are older than a time."""
    files = read_files(spark, path).select("path", "length", "modificationTime").filter(F.col("modificationTime") < older_than)
    return files.join(referenced.select(F.col(column).alias("path")), "path", "left_anti")


def read_log(spark: SparkSession, path: str, base: str = "app.log") -> DataFrame:
    """Lines of a rotated JSON log: ``id, ts, level, message, extra, file``.

    Files are the base name and its archives with a number behind it. Blank and malformed lines and those
    without a valid time are left out; a line without an id gets one from its content.
    """
    raw = spark.read.text(f"{path}/{base}*").select("value", F.col("_metadata.file_name").alias("file"))
    raw = raw.filter(F.col("file").rlike(rf"^{base.replace('.', '[.]')}([.][0-9]+)?$") & (F.trim("value") != ""))
    line = F.from_json("value", LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = raw.withColumn("l", line).filter(F.col("l").isNotNull() & F.col("l.__bad").isNull())
    time = F.try_to_timestamp(F.col("l.ts"))
    made = F.concat(F.lit("legacy_"), F.substring(F.sha2("value", 256), 1, 24))
    out = out.select(F.coalesce("l.id", made).alias("id"), time.alias("ts"), F.coalesce("l.level", F.lit("info")).alias("level"), "l.message", "l.extra", "file")
    return out.filter("ts is not null")


def log_tail(df: DataFrame, per_file: int) -> DataFrame:
    """The newest lines of each file, and whether there were more."""
    w = Window.partitionBy("file").orderBy(F.col("ts").desc(), F.col("id").desc())
    out = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_file + 1)
    more = F.max("__r").over(Window.partitionBy("file")) > per_file
    return out.withColumn("truncated", more).filter(F.col("__r") <= per_file).drop("__r")
