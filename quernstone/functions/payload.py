"""Model output as typed facts: long and short keys, bounded texts, checked enums, evidence.

A payload is JSON in a string column. Each kind of fact is read from an array of string maps, whose values
are coerced by one table of fields; malformed JSON, wrong types and facts without a name give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column of a fact: the keys that it may be under, its type and its bound."""

    keys: tuple[str, ...]
    kind: str = "text"  #: text, number, date or flag
    most: int = 300
    enum: tuple[str, ...] = ()
    other: str | None = None


@dataclass(frozen=True)
class Fact:
    """A kind of fact: where it is in the payload, the column that it can't be without, and its columns."""

    path: str
    required: str
    fields: dict[str, Field] = field(default_factory=dict)


# Keys, bounds and enums of the kinds of facts.
FACTS = {
    "diagnosis": Fact("diagnoses", "diagnosisText", {
        "sectionName": Field(("sectionName", "s"), most=200),
        "diagnosisType": Field(("diagnosisType", "type", "t"), most=40, enum=("admission", "discharge", "outpatient", "pathology", "imaging", "clinical", "other"), other="other"),
        "diagnosisText": Field(("diagnosisText", "text", "n"), most=500),
        "diagnosisCode": Field(("diagnosisCode", "code", "c"), most=100),
        "codeSystem": Field(("codeSystem", "cs"), most=80),
        "isPrimary": Field(("isPrimary", "primary"), "flag"),
    }),
    "medication": Fact("medications", "medicationName", {
        "sectionName": Field(("sectionName", "s"), most=200),
        "medicationName": Field(("medicationName", "name", "n")),
        "genericName": Field(("genericName", "g")),
        "specification": Field(("specification", "spec"), most=200),
        "dosageForm": Field(("dosageForm", "form"), most=100),
        "dose": Field(("dose",), most=100),
        "doseUnit": Field(("doseUnit", "du"), most=80),
        "frequency": Field(("frequency", "freq"), most=100),
        "route": Field(("route",), most=100),
        "duration": Field(("duration",), most=100),
        "quantity": Field(("quantity", "qty"), most=100),
        "quantityUnit": Field(("quantityUnit", "qu"), most=80),
        "instructions": Field(("instructions", "note"), most=500),
    }),
    "procedure": Fact("procedures", "procedureName", {
        "sectionName": Field(("sectionName", "s"), most=200),
        "procedureName": Field(("procedureName", "name", "n")),
        "procedureCode": Field(("procedureCode", "code", "c"), most=100),
        "bodyPart": Field(("bodyPart", "part"), most=200),
        "performedAt": Field(("performedAt", "date"), "date"),
        "resultText": Field(("resultText", "result"), most=1000),
    }),
    "vaccination": Fact("vaccinations", "vaccineName", {
        "vaccineName": Field(("vaccineName", "name", "n")),
        "doseNumber": Field(("doseNumber", "dose"), most=80),
        "manufacturer": Field(("manufacturer", "mfr")),
        "lotNumber": Field(("lotNumber", "lot"), most=120),
        "administeredAt": Field(("administeredAt", "date"), "date"),
        "administrationSite": Field(("administrationSite", "site"), most=120),
        "nextDueAt": Field(("nextDueAt", "nextDate"), "date"),
    }),
    "billing_item": Fact("billingItems", "itemName", {
        "category": Field(("category", "cat"), most=120),
        "itemName": Field(("itemName", "name", "n")),
        "amount": Field(("amount", "a"), "number"),
        "quantity": Field(("quantity", "qty"), "number"),
    }),
    "observation": Fact("observations", "itemName", {
        "sectionName": Field(("sectionName", "s"), most=200),
        "itemCode": Field(("itemCode", "c"), most=100),
        "itemName": Field(("itemName", "n"), most=200),
        "resultText": Field(("resultText", "r"), most=500),
        "numericValue": Field(("numericValue", "v"), "number"),
        "unit": Field(("unit", "u"), most=80),
        "referenceLow": Field(("referenceLow", "lo"), "number"),
        "referenceHigh": Field(("referenceHigh", "hi"), "number"),
        "referenceText": Field(("referenceText", "ref")),
        "abnormalFlag": Field(("abnormalFlag", "f"), most=20, enum=("high", "low", "abnormal", "normal")),
        "method": Field(("method", "m"), most=200),
    }),
}

_MAPS = "array<map<string,string>>"
_EVIDENCE = "array<struct<pageNumber:double,quote:string>>"


def _first(m: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])


def _coerced(m: Column, f: Field) -> Column:
    raw = F.nullif(F.trim(_first(m, f.keys)), F.lit(""))
    if f.kind == "number":
        return raw.try_cast("double")
    if f.kind == "flag":
        return F.coalesce(F.lower(raw).isin("true", "1", "yes", "是", "主要"), F.lit(False))
    if f.kind == "date":
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$"), raw)
    text = F.substring(raw, 1, f.most)
    if f.enum:
        return F.when(text.isin(*f.enum), text).otherwise(F.lit(f.other))
    return text


def evidence_of(m: Column) -> Column:
    """Evidence of a fact, at most 20 quotes: an array under ``evidence``, or the short form of page ``p`` and quote ``q``."""
    listed = F.from_json(F.coalesce(F.try_element_at(m, F.lit("evidence")), F.lit("[]")), _EVIDENCE, {"mode": "PERMISSIVE"})
    clean = F.transform(
        F.slice(F.coalesce(listed, F.array().cast(_EVIDENCE)), 1, 20),
        lambda e: F.struct(F.greatest(F.lit(1), F.round(F.coalesce(e["pageNumber"], F.lit(1.0))).cast("int")).alias("pageNumber"), F.substring(F.trim(e["quote"]), 1, 500).alias("quote")),
    )
    clean = F.filter(clean, lambda e: e["quote"].isNotNull() & (e["quote"] != ""))
    page, quote = F.try_element_at(m, F.lit("p")).try_cast("double"), F.nullif(F.trim(F.try_element_at(m, F.lit("q"))), F.lit(""))
    short = F.array(F.struct(F.round(page).cast("int").alias("pageNumber"), F.substring(quote, 1, 500).alias("quote")))
    return F.when((F.size(clean) == 0) & (page > 0) & quote.isNotNull(), short).otherwise(clean)


def facts(payloads: DataFrame, kind: str, keys: list[str], payload: str = "payload") -> DataFrame:
    """The facts of one kind in each payload: keys, ``position``, the kind's columns and ``evidence``."""
    spec = FACTS[kind]
    items = F.from_json(F.get_json_object(payload, f"$.{spec.path}"), _MAPS, {"mode": "PERMISSIVE"})
    each = payloads.select(*keys, F.posexplode(items).alias("position", "__m")).filter(F.col("__m").isNotNull())
    m = F.col("__m")
    out = each.select(*keys, "position", *[_coerced(m, f).alias(c) for c, f in spec.fields.items()], evidence_of(m).alias("evidence"))
    return out.filter(F.col(spec.required).isNotNull())


def billing_summary(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Totals of a bill; payloads without any have no row."""
    m = F.from_json(F.coalesce(F.get_json_object(payload, "$.billingSummary"), F.get_json_object(payload, "$.billing.summary")), "map<string,string>", {"mode": "PERMISSIVE"})
    fields = {
        "invoiceNumber": Field(("invoiceNumber", "invoiceNo"), most=120), "totalAmount": Field(("totalAmount", "total"), "number"),
        "insuranceAmount": Field(("insuranceAmount", "insurance"), "number"), "selfPayAmount": Field(("selfPayAmount", "selfPay"), "number"),
    }
    out = payloads.select(*keys, m.alias("__m")).filter(F.col("__m").isNotNull())
    out = out.select(*keys, *[_coerced(F.col("__m"), f).alias(c) for c, f in fields.items()], F.coalesce(_coerced(F.col("__m"), Field(("currency",), most=20)), F.lit("CNY")).alias("currency"))
    return out.filter(F.coalesce("invoiceNumber", F.col("totalAmount").cast("string"), F.col("insuranceAmount").cast("string"), F.col("selfPayAmount").cast("string")).isNotNull())


def string_map(json: Column, allowed: list[str] | None = None, most: int = 24, key: int = 60, value: int = 200) -> Column:
    """A JSON object as a map of bounded strings, of allowed keys only where those are given."""
    m = F.coalesce(F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    m = F.map_filter(m, lambda k, v: v.isNotNull() & (F.trim(v) != "") & (k.isin(*allowed) if allowed else F.lit(True)))
    entries = F.slice(F.map_entries(m), 1, most)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.substring(e["key"], 1, key).alias("key"), F.substring(F.trim(e["value"]), 1, value).alias("value"))))


def string_list(json: Column) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(json, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def findings(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Findings of payloads: keys, ``position``, names, side, presence, ``size``, ``classification``, ``measurements``, texts and evidence.

    A finding needs a name (or organ and type) and some text. A size that isn't given is read from the text.
    """
    from .numeric import size_of

    items = F.from_json(F.get_json_object(payload, "$.morphologyFindings"), _MAPS, {"mode": "PERMISSIVE"})
    each = payloads.select(*keys, F.posexplode(items).alias("position", "__m")).filter(F.col("__m").isNotNull())
    m = F.col("__m")
    text = lambda k, n: F.nullif(F.substring(F.trim(F.try_element_at(m, F.lit(k))), 1, n), F.lit(""))
    nested = lambda k, kind: F.from_json(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("null")), kind, {"mode": "PERMISSIVE"})
    said = F.coalesce(text("rawText", 3000), text("morphology", 2000))
    given, read = nested("size", "struct<length:double,width:double,height:double,unit:string>"), size_of(said)
    size = F.struct(*[F.coalesce(given[c], read[c]).alias(c) for c in ("length", "width", "height", "unit")])
    measured = F.coalesce(nested("measurements", "array<struct<key:string,value:double,unit:string>>"), F.array().cast("array<struct<key:string,value:double,unit:string>>"))
    name = F.coalesce(text("findingName", 200), F.nullif(F.concat_ws("", text("organ", 120), text("findingType", 120)), F.lit("")))
    side, presence = text("laterality", 20), text("presence", 20)
    out = each.select(
        *keys, "position", text("sectionName", 200).alias("section_name"), text("organ", 120).alias("organ"), text("region", 120).alias("region"), text("findingType", 120).alias("finding_type"), name.alias("finding_name"),
        F.when(side.isin("left", "right", "bilateral", "midline"), side).otherwise("unspecified").alias("laterality"), F.when(presence.isin("present", "absent", "uncertain"), presence).otherwise("present").alias("presence"),
        size.alias("size"), nested("classification", "struct<system:string,value:string,text:string>").alias("classification"),
        F.slice(F.filter(measured, lambda x: x["key"].isNotNull() & x["value"].isNotNull()), 1, 24).alias("measurements"), text("morphology", 2000).alias("description"), said.alias("raw_text"), evidence_of(m).alias("evidence"),
    )
    return out.filter(F.col("finding_name").isNotNull() & (F.col("raw_text").isNotNull() | (F.size("evidence") > 0)))
