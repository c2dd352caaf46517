"""Tables with explicit schemas, and what a catalog knows of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the record archive's tables that the operators read. Dates are text, as their order is that of text.
SCHEMAS = {
    "members": "id string, display_name string, relationship string, birth_date string, sex string, created_at string, deleted_at string",
    "member_permissions": "member_id string, user_id string, permission string, granted_by string, granted_at string",
    "reports": "id string, member_id string, report_type string, title string, status string, hospital_name_raw string, performing_department string, "
    "reporting_department string, body_parts_json string, identifiers_json string, report_issued_at string, examined_at string, recommendation string, created_at string, updated_at string, deleted_at string",
    "report_pages": "id string, report_id string, page_number int, original_name string, storage_path string, mime_type string, file_size long, sha256 string, source_page_number int, source_page_count int",
    "observations": "id string, report_id string, section_name string, item_name string, normalized_name string, result_text string, numeric_value double, unit string, "
    "reference_low double, reference_high double, reference_text string, abnormal_flag string, evidence_json string",
    "observation_normalizations": "id string, canonical_key string, display_name string, canonical_value double, canonical_unit string, confidence double, quality string, excluded_reason string, version string",
    "dictionary": "normalized_alias string, canonical_key string, display_name string, default_unit string, value_type string, trend_enabled boolean, scope string, allowed_units array<string>, section_hints array<string>",
    "morphology_findings": "id string, report_id string, member_id string, organ string, region string, laterality string, finding_type string, finding_name string, presence string, size_mm double, classification string, description string, raw_text string",
    "ocr_results": "id string, job_id string, page_id string, lines_json string, quality_score int, quality_level string, text_length int, created_at string",
    "processing_jobs": "id string, report_id string, page_id string, job_type string, status string, attempts int, deduplication_key string, lease_expires_at timestamp, next_retry_at timestamp, created_at timestamp",
    "processing_job_events": "id string, job_id string, report_id string, event_type string, status string, attempt int, message string, detail_json string, created_at timestamp",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table by its declared schema; nothing is inferred, and only columns that a query names are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def register(spark: SparkSession, root: str, names: list[str]) -> None:
    """Make tables known by name for SQL."""
    for name in names:
        read_table(spark, root, name).createOrReplaceTempView(name)


def known_tables(spark: SparkSession) -> set[str]:
    """Names of tables and views, without Spark's own."""
    return {t.name for t in spark.catalog.listTables() if not t.name.startswith("__")}


def missing_columns(df: DataFrame, name: str) -> list[str]:
    """Declared columns that a table lacks."""
    declared = [c.strip().split(" ")[0] for c in SCHEMAS[name].split(",")]
    return [c for c in declared if c not in df.columns]


def repaired(df: DataFrame, name: str) -> DataFrame:
    """The table with its declared columns in order; those that it lacks are null."""
    out = []
    for part in SCHEMAS[name].split(","):
        column, kind = part.strip().split(" ", 1)
        out.append((F.col(column) if column in df.columns else F.lit(None)).cast(kind).alias(column))
    return df.select(*out)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table has: ``table, n``."""
    frames = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores over all cores.

    A single small file is one split, and costly expressions on its rows would run on one core. A scan with enough
    splits, as of any large table, is left alone and never shuffled for this.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quernstone-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
