"""Exact deduplication with DataFrame operations only.

Rows are grouped by a 128-bit content hash. Only texts whose hash occurs more than once are
then compared byte by byte, so two texts that merely share a hash are never merged, and
texts without a copy are never shuffled. Grouping combines copies on the map side first: a
group that holds a third of all rows reaches the shuffle as one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Ranges of hashes by which texts without a copy are kept out of shuffles; that many integers are broadcast at most.
SIEVE = 1 << 20


def content_hash(sha256_hex: Column) -> Column:
    """128 bits of the SHA-256 of a text."""
    return F.unhex(F.substring(sha256_hex, 1, 32))


def _spot(h: str) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(SIEVE)).cast("int")


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Decide for every row which row of its group of equal texts stays.

    Returns one row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * ``keep`` is ``smallest`` (the default: the smallest stable id) or ``largest``.
    * A null text counts as empty. Texts of any length are compared whole.
    * Rows that repeat an id and a text count as rows of the group, and each of them is
      ``kept`` when its id is the one that stays.
    * A null id never wins against another id; a group of null ids only keeps them.
    * An empty table gives an empty result; other columns are not looked at.
    * ``hash_of`` derives the hash from the SHA-256 digest; texts whose hashes collide are
      told apart by their bytes.

    Texts of hashes that occur once are not shuffled: the occupied ones of ``SIEVE`` ranges of
    the others' hashes are broadcast, and rows outside them pass by.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    rows = rows.select("doc_id", "__text", F.sha2("__text", 256).alias("text_sha256"))
    rows = rows.withColumn("__h", hash_of(F.col("text_sha256")))
    narrow = rows.select("doc_id", "text_sha256", "__h")
    groups = narrow.groupBy("__h").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(groups.filter("group_size > 1"))
    # Bytes are compared where a hash occurs twice. The join drops what passes the sieve by chance.
    used = groups.select(_spot("__h").alias("__spot")).distinct()
    some = rows.withColumn("__spot", _spot("__h")).join(F.broadcast(used), "__spot", "left_semi")
    texts = some.groupBy("__h", "__text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    per_hash = texts.groupBy("__h").agg(F.count("*").alias("__n"))
    clashing = cut(per_hash.filter("__n > 1").select("__h"))
    found = narrow.join(groups, "__h", "left")
    found = found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        "__h",
    )
    if not clashing.isEmpty():  # texts that share a hash: the whole text joins, for those rows only
        found = found.join(clashing, "__h", "left_anti")
        apart = some.join(clashing, "__h", "left_semi")
        each = apart.groupBy("__h", "__text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(apart.join(each, ["__h", "__text"]).select("doc_id", "keep_id", "group_size", "text_sha256", "__h"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each group of equal texts: the one with the smallest id.

    All columns of the kept row are returned as they were, whatever their names and types. A null
    text equals an empty one. Among rows that also share the id, one with a text stays before one
    without, then the smallest by the other columns as JSON, so the result does not depend on how
    rows are dealt out; rows that agree in all of that are alike. Null ids come last. An empty table
    gives an empty result.

    Texts whose hash occurs once pass by without a shuffle, as in ``exact_groups``.
    """
    names = df.columns
    inner = [f"c{i}" for i in range(len(names))]  # own names, so that no column of the table can clash
    i, t = f"c{names.index(id_col)}", F.col(f"c{names.index(text_col)}").cast("string")
    rows = df.toDF(*inner).select("*", F.coalesce(t, F.lit("")).alias("text"))
    rows = rows.withColumn("h", content_hash(F.sha2("text", 256)))
    hashes = rows.select("h").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    used = F.broadcast(cut(hashes.select(_spot("h").alias("spot")).distinct()))
    rows = rows.withColumn("spot", _spot("h"))
    alone = rows.join(used, "spot", "left_anti").select(inner)
    others = [c for c in inner if c not in (i, f"c{names.index(text_col)}")]
    order = F.struct(F.col(i).isNull(), F.col(i), t.isNull(), F.to_json(F.struct(*others)) if others else F.lit(""))
    whole = F.struct(*[c for c in inner if c != f"c{names.index(text_col)}"], t.isNull().alias("none"))
    kept = rows.join(used, "spot", "left_semi").groupBy("h", "text").agg(F.min_by(whole, order).alias("row"))
    text = F.when(~F.col("row.none"), F.col("text")).cast(df.schema[text_col].dataType)
    kept = kept.select(*[(text if n == text_col else F.col(f"row.{c}")).alias(c) for n, c in zip(names, inner, strict=True)])
    return alone.unionByName(kept).toDF(*names)
