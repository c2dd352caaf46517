"""Writing: latest-wins upserts, insert-if-absent, replacement of derived rows, append-only logs, exports.

Plain Parquet has no transactions. A rewrite goes to a new version folder, and a table of versions says
which is current, so a reader sees the old or the new state, never a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import LOG_REDACTIONS, redact
from quernstone.operators.dictionary import content_hash
from quernstone.operators.diffs import insert_absent, newest_rows


VERSIONS = "version long, folder string"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions of a table that were published, or None before the first."""
    try:
        return spark.read.schema(VERSIONS).json(f"{path}/_versions")
    except Exception as e:  # no such folder yet: every store has its own wording
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise


def current_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the current version; ``(0, None)`` before the first."""
    known = _versions(spark, path)
    last = known.orderBy(F.col("version").desc(), "folder").first() if known is not None else None
    return (last.version, last.folder) if last else (0, None)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a table, or None before the first."""
    _, folder = current_version(spark, path)
    return spark.read.parquet(f"{path}/{folder}") if folder else None


def _point(spark: SparkSession, path: str, folder: str, base: int) -> int:
    """Make a folder the version after ``base``, if no other writer has done so.

    The right to follow a version is a file that only one writer can create, as stores create a file without overwriting it
    in one step. It is created before the version is written, so a writer that comes second fails and changes nothing.
    """
    jvm = spark._jvm
    claim = jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/after-{base:012d}")
    files = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(claim.getParent())
    if claim.toUri().getScheme() in (None, "file") and files.getScheme() == "file":
        won = bool(jvm.java.io.File(claim.toUri().getPath()).createNewFile())  # Hadoop's local files don't create in one step
    else:
        won = bool(files.createNewFile(claim))
    if not won:
        raise RuntimeError(f"another writer has published a version after {base} of {path}")
    spark.createDataFrame([(base + 1, folder)], VERSIONS).write.mode("append").json(f"{path}/_versions")
    return base + 1


def publish(df: DataFrame, path: str, base: int | None = None) -> int:
    """Write a table as its next version and make that current; returns the version.

    With ``base``, the version that the rows were made from, it is an error if another version has been published since, so that no
    writer's rows are lost; without, the rows follow whatever is current. Of writers at the same time one succeeds, and the others get an error
    and may try again on the new version. A writer that dies between its claim and its version leaves a file ``_claims/after-<base>``
    that has to be removed by hand.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return _point(spark, path, folder, current_version(spark, path)[0] if base is None else base)


def activate(df: DataFrame, path: str, columns: list[str], expected: str | None = None, base: int | None = None) -> int:
    """Make a dictionary current, if its rows have the digest ``expected``; returns the version.

    Where the current version has the same digest, nothing is written. ``base`` as in ``publish``.
    """
    digest = content_hash(df, columns).first().digest
    if expected is not None and digest != expected:
        raise ValueError(f"the dictionary's digest is {digest}, not {expected}")
    spark = df.sparkSession
    version, folder = current_version(spark, path)
    if base is not None and base != version:
        raise RuntimeError(f"version {version} of {path} is current, not {base}")
    if folder and content_hash(spark.read.parquet(f"{path}/{folder}"), columns).first().digest == digest:
        return version
    return publish(df, path, version)


def roll_back(spark: SparkSession, path: str, to: int, base: int | None = None) -> int:
    """Make an earlier version's rows current again, as a new version; returns it. ``base`` as in ``publish``."""
    known = _versions(spark, path)
    found = known.filter(F.col("version") == to).orderBy("folder").first() if known is not None else None
    if found is None:
        raise ValueError(f"{path} has no version {to}")
    return _point(spark, path, found.folder, current_version(spark, path)[0] if base is None else base)


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str]) -> int:
    """Add rows; of rows with one key the newest by ``order`` stays."""
    base, _ = current_version(new.sparkSession, path)
    old = current(new.sparkSession, path)
    return publish(newest_rows(new if old is None else old.unionByName(new), keys, order), path, base)


def insert_if_absent(new: DataFrame, path: str, keys: list[str]) -> int:
    """Add rows whose key isn't there yet."""
    base, _ = current_version(new.sparkSession, path)
    old = current(new.sparkSession, path)
    return publish(new.dropDuplicates(keys) if old is None else insert_absent(old, new, keys), path, base)


def append_audit(df: DataFrame, path: str, action: Column, detail: list[str], most: int = 500) -> None:
    """Append rows of an audit log; details are JSON, and long strings are cut."""
    cut = {c: F.substring(F.col(c).cast("string"), 1, most) for c in detail}
    rows = df.select(F.expr("uuid()").alias("id"), action.alias("action"), F.to_json(F.struct(*[v.alias(c) for c, v in cut.items()])).alias("detail_json"), F.current_timestamp().alias("created_at"))
    rows.write.mode("append").parquet(path)


def export_nested(reports: DataFrame, children: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """The newest reports of each member with their children as one JSON document each: ``member_id, report_id, document``."""
    from quernstone.operators.listing import top_per_group

    some = top_per_group(reports, ["member_id"], [F.col("report_issued_at").desc_nulls_last(), F.col("id").desc()], most)
    out = some
    for name, child in children.items():
        columns = [c for c in child.columns if c != "report_id"]
        packed = child.groupBy(F.col("report_id").alias("__r")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(packed, out["id"] == F.col("__r"), "left").drop("__r")
    return out.select("member_id", F.col("id").alias("report_id"), F.to_json(F.struct(*[c for c in out.columns if c != "member_id"])).alias("document"))


def redacted_bundle(logs: DataFrame) -> DataFrame:
    """Log lines fit to be sent away: messages and extra values redacted."""
    extra = F.transform_values("extra", lambda k, v: F.when(F.lower(F.regexp_replace(k, "[^A-Za-z0-9]", "")).rlike("^(apikey|authorization|accesstoken|refreshtoken|password|passwd|secret|clientsecret|cookie|setcookie)$"), F.lit("[redacted]")).otherwise(redact(v, LOG_REDACTIONS)))
    return logs.withColumn("message", redact(F.col("message"), LOG_REDACTIONS)).withColumn("extra", extra)


def dictionary_manifest(files: DataFrame) -> DataFrame:
    """``path, bytes, sha256`` of the files of a dictionary (columns ``path, content``)."""
    return files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
