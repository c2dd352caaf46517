"""Extracted facts against the lines they come from: evidence, coverage, merging, de-duplication."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quernstone.functions.text import narrow

from .grounding import lines_of_results


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(narrow(F.coalesce(text, F.lit("")))), r"[\s\p{P}\p{S}]+", "")


def supported(facts: DataFrame, lines: DataFrame, most: int = 5) -> DataFrame:
    """The lines that support each fact: ``fact_id, line_id, score``, the best ``most``; see ``grounding.lines_of_results``.

    Without a column ``line_no``, lines of a page are in the order of their ids.
    """
    if "line_no" not in lines.columns:
        lines = lines.withColumn("line_no", F.lit(0))
    return lines_of_results(facts, lines, most)


def source_line(evidence: DataFrame) -> DataFrame:
    """The one line that a fact comes from: the best, if it beats the second: ``fact_id, line_id``."""
    top = evidence.groupBy("fact_id").agg(F.max(F.struct("score", "line_id")).alias("b"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"))
    alone = (F.size("s") < 2) | (F.get("s", F.lit(0)) > F.get("s", F.lit(1)))
    return top.filter(alone).select("fact_id", F.col("b.line_id").alias("line_id"))


def verified(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts that have evidence; the others are left out."""
    return facts.join(evidence.select("fact_id"), "fact_id", "left_semi")


def coverage(candidates: DataFrame, evidence: DataFrame, local: DataFrame) -> DataFrame:
    """What became of each candidate line: ``line_id, outcome`` (local, ai, redundant when both, unresolved)."""
    a, b = evidence.select("line_id").distinct().withColumn("__ai", F.lit(True)), local.select("line_id").distinct().withColumn("__local", F.lit(True))
    out = candidates.join(a, "line_id", "left").join(b, "line_id", "left")
    ai, mine = F.col("__ai").isNotNull(), F.col("__local").isNotNull()
    return out.select("line_id", F.when(ai & mine, "redundant").when(mine, "local").when(ai, "ai").otherwise("unresolved").alias("outcome"))


def omission_blocks(missing: DataFrame, size: int = 30) -> DataFrame:
    """Lines that no fact explains, in blocks of one page and mode for a second look: adds ``block``."""
    w = Window.partitionBy("report_id", "page_number", "mode").orderBy("line_no")
    return missing.withColumn("block", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def best_fields(values: DataFrame) -> DataFrame:
    """The most confident value of each field, the first on a tie: ``report_id, field, value`` from rows with ``confidence, position``."""
    used = values.filter(F.trim("value") != "")
    return used.groupBy("report_id", "field").agg(F.max_by("value", F.struct("confidence", -F.col("position"))).alias("value"))


def merge_sections(sections: DataFrame) -> DataFrame:
    """Sections of one key as one: distinct contents in order, evidence united, the highest confidence."""
    items = F.array_sort(F.collect_list(F.struct("position", "content_text", "evidence")))
    out = sections.groupBy("report_id", "section_key").agg(items.alias("i"), F.max("confidence").alias("confidence"))
    said = F.array_distinct(F.filter(F.transform("i", lambda x: F.trim(x["content_text"])), lambda t: t != ""))
    proof = F.array_distinct(F.flatten(F.transform("i", lambda x: F.coalesce(x["evidence"], F.array()))))
    return out.select("report_id", "section_key", F.array_join(said, "\n").alias("content_text"), proof.alias("evidence"), "confidence")


def completeness(columns: list[str]) -> Column:
    """How many of the columns are filled."""
    total = F.lit(0)
    for c in columns:
        total = total + (F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int")
    return total


def without_protected(facts: DataFrame, manual: DataFrame, identity: list[str]) -> DataFrame:
    """New facts that no fact edited by hand stands for already: neither by identity nor by a shared piece of evidence."""
    out = facts.join(manual.select("report_id", *identity), ["report_id", *identity], "left_anti")
    proof = manual.select("report_id", F.explode("evidence_keys").alias("e")).distinct()
    each = out.select("fact_id", "report_id", F.explode("evidence_keys").alias("e")).join(proof, ["report_id", "e"], "left_semi")
    return out.join(each.select("fact_id"), "fact_id", "left_anti")


def match_protected(new: DataFrame, manual: DataFrame, score: Column, least: float = 52.0) -> DataFrame:
    """Pairs of new and manual facts of a report that are each other's best match: ``fact_id, manual_id``.

    ``score`` is an expression over aliases ``n`` and ``m``. A tie for the best match of a fact is no match, and a manual fact
    is used once, for the new fact that scores highest.
    """
    both = new.alias("n").join(manual.alias("m"), F.col("n.report_id") == F.col("m.report_id")).select(F.col("n.fact_id").alias("fact_id"), F.col("m.fact_id").alias("manual_id"), score.alias("score"))
    w = Window.partitionBy("fact_id").orderBy(F.col("score").desc())
    best = both.filter(F.col("score") >= least).withColumn("__k", F.rank().over(w)).filter("__k = 1")
    alone = best.withColumn("__n", F.count("*").over(Window.partitionBy("fact_id"))).filter("__n = 1")
    once = Window.partitionBy("manual_id").orderBy(F.col("score").desc(), "fact_id")
    return alone.withColumn("__u", F.row_number().over(once)).filter("__u = 1").select("fact_id", "manual_id")


def fold_compatible(facts: DataFrame, exact: list[str], nullable: list[str], rank: list[str]) -> DataFrame:
    """Greedy de-duplication within a report: rows with equal exact keys are one if their nullable keys don't contradict.

    A null agrees with anything, so being the same isn't transitive and the order decides: rows are taken by ``rank``, and each
    joins the first kept row that it agrees with, whose missing values it fills. Groups stream through their task in order,
    many to a batch; only the kept rows of the one at hand are held.
    """
    keys = ["report_id", *exact]
    rows = facts.repartition(*keys).sortWithinPartitions(*keys, *rank)
    schema = to_arrow_schema(facts.schema)

    def run(batches):
        now: tuple | None = None
        kept: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in keys)
                if key != now:
                    done += kept
                    now, kept = key, []
                for k in kept:
                    if all(row[c] is None or k[c] is None or row[c] == k[c] for c in nullable):
                        k.update({c: v for c, v in row.items() if k[c] is None})
                        break
                else:
                    kept.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema=schema)

    return rows.mapInArrow(run, facts.schema)


def not_extracted(local: DataFrame, extracted: DataFrame) -> DataFrame:
    """Facts read from the lines themselves that no extracted fact stands for.

    Both have ``fact_id, report_id, item_name, normalized_name, result_text`` and ``evidence`` (page number and quote). One stands for another when
    name (or normalised name), result and a piece of evidence are equal once spaces and punctuation are gone.
    """

    def keys(df: DataFrame, *more: str) -> DataFrame:
        names = F.array_distinct(F.array(F.concat(F.lit("a"), compact(F.col("item_name"))), F.concat(F.lit("b"), compact(F.col("normalized_name")))))
        rows = df.select("report_id", *more, compact(F.col("result_text")).alias("r"), names.alias("names"), F.explode("evidence").alias("e"))
        return rows.select("report_id", *more, "r", F.explode("names").alias("n"), F.col("e.pageNumber").alias("p"), compact(F.col("e.quote")).alias("q"))

    met = keys(local, "fact_id").join(keys(extracted), ["report_id", "r", "n", "p", "q"], "left_semi")
    return local.join(met.select("fact_id"), "fact_id", "left_anti")
