"""Edits by people and what follows from them: pins, facts and findings kept by hand, units attached, sections repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import report_rules as R
from quernstone.functions.numeric import size_of
from quernstone.functions.rules import first_match

from .screening import section_fits

# Specimens by the words that name them, first match wins.
SPECIMENS = (
    (r"全血", "whole_blood"), (r"血清", "serum"), (r"血浆", "plasma"), (r"尿液|尿标本|尿常规", "urine"), (r"便常规|粪便|大便", "stool"), (r"痰液|痰标本", "sputum"), (r"脑脊液", "cerebrospinal_fluid"),
)
HISTORICAL, CURRENT = r"历史|既往|上次|前次|往年|去年|前年|历次|复查前", r"本次|当前"


def toggle_pins(pins: DataFrame, asked: DataFrame) -> DataFrame:
    """Pins after some were asked for (``user_id, member_id, series_key``): a pin that is there goes, another comes."""
    keys = ["user_id", "member_id", "series_key"]
    once = asked.select(*keys).distinct()
    return pins.join(once, keys, "left_anti").select(*keys).unionByName(once.join(pins.select(*keys), keys, "left_anti"))


def migrate_pins(pins: DataFrame, moved: DataFrame) -> DataFrame:
    """Pins of keys that were replaced (``old_key, new_key``) move to the new ones."""
    m = moved.select(F.col("old_key").alias("series_key"), "new_key")
    out = pins.join(m, "series_key", "left")
    return out.select("user_id", "member_id", F.coalesce("new_key", "series_key").alias("series_key")).distinct()


def apply_edits(facts: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Facts with the fields that people changed; these are named in ``manual_fields`` and later extractions leave them.

    ``edits``: ``fact_id, field, value, at``, the newest of a field counts; the field ``is_deleted`` removes a fact softly.
    """
    e = edits.groupBy("fact_id", "field").agg(F.max_by(F.struct("value"), "at").alias("v"))
    wide = e.groupBy("fact_id").agg(F.array_sort(F.collect_list("field")).alias("__fields"), *[F.max(F.when(F.col("field") == c, F.col("v"))).alias(f"__{c}") for c in [*columns, "is_deleted"]])
    kinds = dict(facts.dtypes)
    out = facts.join(wide, "fact_id", "left")
    made = {c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.value").try_cast(kinds[c])).otherwise(F.col(c)) for c in columns}
    made["manual_fields"] = F.array_sort(F.array_union(F.coalesce("manual_fields", F.array().cast("array<string>")), F.coalesce("__fields", F.array().cast("array<string>"))))
    made["is_deleted"] = F.coalesce(F.col("__is_deleted.value").try_cast("boolean"), "is_deleted")
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in facts.columns])


def relink(findings: DataFrame, links: DataFrame) -> DataFrame:
    """Findings after people linked or separated them: ``id, group_id`` (null: on its own); such links are manual.

    The newest link of a finding by ``at`` counts. A finding on its own gets an id from its own.
    """
    new = links.groupBy("id").agg(F.max_by(F.struct("group_id"), "at").alias("g"))
    out = findings.join(new, "id", "left")
    own = F.concat(F.lit("morph_own_"), F.substring(F.sha2("id", 256), 1, 20))
    mine = F.col("g").isNotNull()
    made = {
        "group_id": F.when(mine, F.coalesce("g.group_id", own)).otherwise(F.col("group_id")),
        "manual_fields": F.when(mine, F.array_union(F.coalesce("manual_fields", F.array().cast("array<string>")), F.array(F.lit("group_id")))).otherwise(F.col("manual_fields")),
    }
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in findings.columns])


def keep_manual_links(old: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rebuilt timelines in which links made by hand stay as they are."""
    manual = old.filter(F.array_contains(F.coalesce("manual_fields", F.array().cast("array<string>")), "group_id")).select("id", F.col("group_id").alias("__g"), F.lit(True).alias("__m"))
    out = rebuilt.join(manual, "id", "left")
    return out.withColumn("group_id", F.when(F.col("__m"), F.col("__g")).otherwise(F.col("group_id"))).drop("__g", "__m")


def not_ignored(findings: DataFrame) -> DataFrame:
    """Findings that nobody asked to ignore."""
    return findings.filter(~F.array_contains(F.coalesce("manual_fields", F.array().cast("array<string>")), "ignored"))


def repair_sections(sections: DataFrame, reports: DataFrame) -> DataFrame:
    """Sections without those that a model put under a report of another type; what people touched stays."""
    r = reports.select(F.col("id").alias("report_id"), "report_type")
    untouched = (F.col("source") == "ai") & (F.size(F.coalesce("manual_fields", F.array().cast("array<string>"))) == 0)
    bad = sections.join(r, "report_id").filter(untouched & ~section_fits(F.col("report_type"), F.col("section_key"))).select("id")
    return sections.join(bad, "id", "left_anti")


def attach_events(events: DataFrame, units: DataFrame) -> DataFrame:
    """Events with their unit: by key, else by index where only one unit of the job has that index: adds ``unit_id``."""
    by_key = units.select("job_id", "unit_key", F.col("unit_id").alias("__k"))
    single = units.groupBy("job_id", "unit_index").agg(F.count("*").alias("n"), F.min("unit_id").alias("__i")).filter("n = 1").drop("n")
    out = events.join(by_key, ["job_id", "unit_key"], "left").join(single, ["job_id", "unit_index"], "left")
    return out.select(*events.columns, F.coalesce("__k", "__i").alias("unit_id"))


def lookup_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages by pairs of report and page number."""
    return pages.join(wanted.select("report_id", "page_number").distinct(), ["report_id", "page_number"], "left_semi")


def observation_context(section: Column, item: Column, result: Column, method: Column, quotes: Column) -> Column:
    """When and from what a result is: struct of ``temporal, measured_at, specimen``."""
    text = F.concat_ws(" ", section, item, result, method, F.array_join(quotes, " "))
    past = text.rlike(HISTORICAL) & ~text.rlike(CURRENT)
    at = F.regexp_extract(text, r"\b20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:日)?(?:\s+\d{1,2}[:：]\d{2})?", 0)
    clock = F.regexp_extract(text, r"\b\d{1,2}[:：]\d{2}\b", 0)
    return F.struct(
        F.when(past, "historical").otherwise("current").alias("temporal"), F.coalesce(F.nullif(at, F.lit("")), F.nullif(clock, F.lit(""))).alias("measured_at"), first_match(text, SPECIMENS).alias("specimen")
    )


def findings_from_observations(observations: DataFrame) -> DataFrame:
    """Observations that describe findings, as findings: organ, side, type, size and presence from their words."""
    text = F.concat_ws(" ", "item_name", "result_text")
    raw = F.coalesce("quote", F.concat_ws("：", "item_name", "result_text"))
    return observations.select(
        "report_id", "section_name", first_match(text, R.ORGANS).alias("organ"), first_match(raw, R.SIDES, F.lit("unspecified")).alias("laterality"),
        first_match(text, R.FINDING_TYPES, F.lit("形态发现")).alias("finding_type"), F.col("item_name").alias("finding_name"),
        F.when(F.col("result_text").rlike("未见|未发现|无明显"), "absent").otherwise("present").alias("presence"), size_of(F.col("result_text")).alias("size"), F.col("result_text").alias("description"), raw.alias("raw_text"),
    )


def fixed_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in the order of a list; what isn't in it comes last, by name."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(at == 0, len(order) + 1).otherwise(at), column)


def corrected_result(result: Column, cell: Column) -> Column:
    """A result against the table cell that it was read from: the cell's number or word where they differ, null for a dash."""
    c = F.trim(cell)
    number = F.regexp_extract(c, r"^(?:<|<=|≤|>|>=|≥)?\s*[-+]?\d+(?:\.\d+)?", 0)
    word = F.regexp_extract(c, r"^(?:弱阳性|阴性|阳性|正常|异常|未见异常|未见|可见)", 0)
    return F.when(c.rlike(r"^[-—–/]+$"), F.lit(None).cast("string")).when(number != "", number).when(word != "", word).otherwise(result)


def members_after(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after new, changed and removed ones: the newest change of each id by ``at`` counts."""
    columns = [c for c in members.columns if c != "at"]
    both = members.select(*columns, F.lit(None).cast("timestamp").alias("at")).unionByName(changes.select(*columns, F.col("at").cast("timestamp")))
    w = Window.partitionBy("id").orderBy(F.col("at").desc_nulls_last())
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "at")


def rebind_admin(permissions: DataFrame, members: DataFrame, admin: str) -> DataFrame:
    """Permissions after a restore: the administrator manages every member."""
    mine = members.filter("deleted_at is null").select(F.col("id").alias("member_id"), F.lit(admin).alias("user_id"), F.lit("manager").alias("permission"))
    others = permissions.select("member_id", "user_id", "permission").filter(F.col("user_id") != admin)
    return others.unionByName(mine)
