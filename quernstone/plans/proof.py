"""Queries over facts and the lines that prove them: evidence, coverage, merging, payloads, contexts, measurements, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import line_rules as L
from quernstone.functions import measurements as M
from quernstone.functions import payload as Y
from quernstone.operators import documents as O
from quernstone.operators import duplicates as U
from quernstone.operators import evidence as V
from quernstone.operators import folds as D
from quernstone.operators import screening as S
from quernstone.operators.aggregates import signature
from quernstone.sources.tables import spread

from .findings import _list, _pick
from .lines import LINES, PHRASES, SPACE, _cut, _gone, _has, lines, narrowed, roles_sql
from .tables import table

NAMES = ("白细胞计数", "血红蛋白", "总胆固醇", "囊肿", "CRP", "结节")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts said to come from a page: with a line's words as a quote, with a name and a number, or with neither."""
    i = F.col("line_id")
    x = lines(spark, sf_dir).filter(i % 2 == 0)
    quote = F.when(i % 3 == 0, F.substring(F.col("text"), 2, 9)).when(i % 3 == 1, F.concat(F.col("text"), F.lit("！？"))).otherwise("别处")
    return x.select(i.alias("fact_id"), "report_id", "page_number", quote.alias("quote"), _pick(NAMES, i + F.col("member_id")).alias("name"), (F.abs(F.floor("value")).cast("long") % 9 + 1).cast("string").alias("value"))


def _supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.supported(_facts(spark, sf_dir), lines(spark, sf_dir).select("line_id", "report_id", "page_number", "line_no", "text"), 3)


def lines_that_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three lines that support each fact."""
    return _supported(spark, sf_dir)


def facts_with_a_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that have evidence, with the line that they come from where one is best."""
    e = _supported(spark, sf_dir)
    kept = V.verified(_facts(spark, sf_dir).select("fact_id"), e)
    return kept.join(V.source_line(e), "fact_id", "left").select("fact_id", F.coalesce("line_id", F.lit(-1)).alias("line_id"))


def lines_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each candidate line: read by rules, by a model, by both or by neither; the last in blocks for a second look."""
    x = lines(spark, sf_dir)
    candidates = x.filter(S.is_candidate(F.col("text")))
    done = V.coverage(candidates.select("line_id"), _supported(spark, sf_dir), candidates.filter("line_id % 5 < 2"))
    open_ = done.filter("outcome = 'unresolved'").join(x, "line_id").select("line_id", "report_id", "page_number", F.col("event_type").alias("mode"), "line_no")
    blocks = V.omission_blocks(open_, 2)
    return done.join(blocks.select("line_id", "block"), "line_id", "left").select("line_id", "outcome", F.coalesce("block", F.lit(-1)).alias("block"))


def fields_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident value of each field of a report."""
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.floor(i / 20).alias("report_id"), F.col("event_type").alias("field"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("v"), i)).alias("value"), (i * 7 % 5 / 5).alias("confidence"), i.alias("position"))
    return V.best_fields(x)


def sections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(
        F.floor(i / 12).alias("report_id"), F.col("event_type").alias("section_key"), i.alias("position"), F.concat(F.lit(" t"), i % 3).alias("content_text"), F.when(i % 4 > 0, F.array((i % 2).cast("string"), F.col("user_id").cast("string"))).alias("evidence"), (i % 9 / 10).alias("confidence")
    )
    return V.merge_sections(x).select("report_id", "section_key", F.replace("content_text", F.lit("\n"), F.lit("/")).alias("content"), F.array_join(F.array_sort("evidence"), ",").alias("evidence"), "confidence")


def rows_by_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select("event_id", F.when(i % 2 == 0, "").otherwise("x").alias("a"), F.when(i % 3 == 0, i).alias("b"), F.col("props").alias("c"))
    return x.select("event_id", V.completeness(["a", "b", "c"]).alias("filled"))


def facts_not_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts that no fact edited by hand stands for: neither by name nor by a piece of evidence."""
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(i.alias("fact_id"), F.floor(i / 30).alias("report_id"), (i * 3 % 17).alias("name"), F.array((i % 19).cast("string"), (i * 5 % 23).cast("string")).alias("evidence_keys"), "event_type")
    return V.without_protected(x.filter("event_type <> 'signup'"), x.filter("event_type = 'signup'"), ["name"]).select("fact_id")


def facts_matched_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a new fact and one edited by hand that are each other's best match, without ties."""
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(i.alias("fact_id"), F.floor(i / 25).alias("report_id"), (i * 7 % 13).alias("n"), "event_type")
    score = F.lit(70.0) - 3 * F.abs(F.col("n.n") - F.col("m.n"))
    return V.match_protected(x.filter("event_type = 'click'"), x.filter("event_type = 'purchase'"), score)


def facts_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one name are one if their units don't contradict; a missing unit agrees with anything, so their order decides."""
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.floor(i / 15).cast("long").alias("report_id"), F.col("event_type").alias("name"), F.when(i % 3 > 0, F.concat(F.lit("u"), i * 5 % 4)).alias("unit"), i.alias("position"))
    return V.fold_compatible(x, ["name"], ["unit"], ["position"]).select("report_id", "name", F.coalesce("unit", F.lit("")).alias("unit"), "position")


def results_not_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results read from lines that no extracted one stands for, by name, result and evidence."""
    i = F.col("event_id")
    proof = lambda page: F.array(F.struct(page.alias("pageNumber"), F.concat(F.lit("q "), F.col("user_id") % 3).alias("quote")))
    x = table(spark, sf_dir, "events").withColumn("report_id", F.floor(i / 40))
    local = x.filter(i % 2 == 0).select(i.alias("fact_id"), "report_id", F.concat(F.lit("WBC-"), i % 5).alias("item_name"), F.concat(F.lit("n"), i % 7).alias("normalized_name"), (i % 3).cast("string").alias("result_text"), proof(F.floor(i / 2) % 2).alias("evidence"))
    other = x.filter(i % 2 == 1).select(i.alias("fact_id"), "report_id", F.concat(F.lit("wbc "), i % 5).alias("item_name"), F.concat(F.lit("N-"), i % 7).alias("normalized_name"), (i % 3).cast("string").alias("result_text"), proof(F.floor(i / 2) % 2).alias("evidence"))
    return V.not_extracted(local, other).select("fact_id")


def facts_of_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of payloads: long and short keys, numbers, enums, cut texts, evidence in either form."""
    i, u = F.col("event_id"), F.col("user_id")
    long = F.struct(F.lit("  Name  ").alias("itemName"), F.col("value").cast("string").alias("numericValue"), F.when(i % 2 == 0, "high").otherwise("odd").alias("abnormalFlag"), F.repeat(F.lit("u"), 90).alias("unit"), F.to_json(F.array(F.struct(F.lit(2.6).alias("pageNumber"), F.lit(" said ").alias("quote")))).alias("evidence"))
    short = F.struct(F.concat(F.lit("n"), u).alias("n"), F.lit("x").alias("v"), F.lit("low").alias("f"), F.lit("3").alias("p"), F.concat(F.lit("q"), u).alias("q"))
    none = F.struct(F.lit(" ").alias("itemName"))
    payload = F.concat(F.lit('{"observations":['), F.to_json(long), F.lit(","), F.to_json(short), F.lit(","), F.to_json(none), F.lit("]}"))
    x = table(spark, sf_dir, "events").select("event_id", F.when(i % 11 == 0, "{broken").otherwise(payload).alias("payload"))
    f = Y.facts(x, "observation", ["event_id"])
    return f.select(
        "event_id", "position", "itemName", F.coalesce("numericValue", F.lit(-1.0)).alias("number"), F.coalesce("abnormalFlag", F.lit("")).alias("flag"), F.coalesce(F.length("unit"), F.lit(0)).alias("unit_length"),
        F.coalesce(F.get("evidence", F.lit(0))["pageNumber"], F.lit(0)).alias("page"), F.coalesce(F.get("evidence", F.lit(0))["quote"], F.lit("")).alias("quote"),
    )


def lists_and_maps_of_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists and maps of strings, of allowed keys only, and totals of bills."""
    i, u = F.col("event_id"), F.col("user_id")
    x = table(spark, sf_dir, "events").select(
        "event_id", F.when(i % 4 == 0, '["a","b"]').when(i % 4 == 1, '{"no":1}').alias("list"), F.concat(F.lit('{"keep":" x'), u, F.lit('","drop":"y","blank":" "}')).alias("map"),
        F.when(i % 5 == 0, F.concat(F.lit('{"billingSummary":{"total":"'), u, F.lit('.5","currency":"USD"}}'))).when(i % 5 == 1, F.lit('{"billing":{"summary":{"invoiceNo":"A1"}}}')).otherwise(F.lit('{"billingSummary":{}}')).alias("payload"),
    )
    bills = Y.billing_summary(x, ["event_id"]).select(F.col("event_id").alias("__e"), "invoiceNumber", "totalAmount", "currency")
    out = x.join(bills, F.col("event_id") == F.col("__e"), "left")
    return out.select(
        "event_id", F.size(Y.string_list(F.col("list"))).alias("n"), F.to_json(Y.string_map(F.col("map"), ["keep", "blank"])).alias("map"), F.coalesce("totalAmount", F.lit(-1.0)).alias("total"), F.coalesce("invoiceNumber", F.lit("")).alias("invoice"), F.coalesce("currency", F.lit("")).alias("currency")
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    return x.select("line_id", F.col("report_id").alias("doc_id"), F.col("page_number").alias("page"), "line_no", "text", S.boundary(F.col("text")).alias("boundary"), S.is_candidate(F.col("text")).alias("candidate"))


def contexts_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section and table header that each line stands under, over pages."""
    out = D.carry_context(_pages(spark, sf_dir))
    return out.select("doc_id", "page", "line_no", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("table_header", F.lit("")).alias("header"))


def lines_without_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without pages of general advice and without earlier results."""
    return D.without_education(_pages(spark, sf_dir)).select("line_id")


def lines_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recognised pages, read from their JSON: blank ones go, confidence is cut, ids are made up."""
    i = F.col("line_id")
    one = F.struct(F.when(i % 3 == 0, F.concat(F.lit("L"), i)).alias("id"), F.concat(F.lit(" "), F.col("text")).alias("text"), (i % 5 / 3).alias("confidence"))
    pages = lines(spark, sf_dir).select(i.alias("page_id"), "page_number", F.to_json(F.array(one, F.struct(F.lit(None).cast("string").alias("id"), F.lit("  ").alias("text"), F.lit(0.5).alias("confidence")))).alias("lines_json"))
    return O.parse_lines(pages).select("page_id", "line_id", "line_no", F.sha2("text", 256).alias("text"), F.round("confidence", 4).alias("confidence"))


def results_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that stand in table rows, by the cells of the header or by their places."""
    i = F.col("line_id")
    header = F.when(i % 3 == 0, "项目名称 | 历史结果 | 本次结果 | 单位 | 参考范围").when(i % 3 == 1, "项目 | 结果 | 参考")
    q = (F.abs(F.floor("value")).cast("long") % 9 + 1).cast("string")
    row = F.when(i % 3 == 0, F.concat(F.lit("白细胞 | 9.9 | "), q, F.lit(".5 ↑ | 10^9/L | 3.5-9.5"))).when(i % 3 == 1, F.concat(F.lit("尿蛋白 | 阴性 | "), q)).otherwise(F.concat(F.lit("血糖 | "), q, F.lit(" mmol/L | <6.1")))
    x = lines(spark, sf_dir).select("line_id", F.when(i % 7 == 0, F.lit("检查日期 | 2024-01-01")).when(i % 11 == 0, F.lit("尿糖 | 阴性异常 | 5.2异常")).otherwise(row).alias("text"), header.alias("table_header"), F.when(i % 10 == 0, 0.5).otherwise(0.9).alias("confidence"))
    out = S.table_results(x)
    none = F.lit(-1.0)
    return out.select("line_id", "item_name", "result_text", F.coalesce("numeric_value", none).alias("number"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("range.low", none).alias("low"), F.coalesce("range.high", none).alias("high"), F.coalesce("flag", F.lit("")).alias("flag"))


def measurements_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first plausible value of each basic measurement of a report, and vascular values of either side."""
    i = F.col("line_id")
    q = F.abs(F.floor("value")).cast("long")
    said = F.get(F.array(F.concat(F.lit("身高 "), q % 400, F.lit(" cm")), F.concat(F.lit("体重：6"), q % 9, F.lit(".5kg")), F.concat(F.lit("血压 1"), q % 90 + 10, F.lit("/"), q % 60 + 50, F.lit("mmHg")), F.concat(F.lit("BMI 2"), q % 9), F.lit("脉搏 300 次/分"), F.concat(F.lit("ABI 右侧: 1."), q % 9), F.concat(F.lit("左 baPWV "), q % 30 * 100)), (i % 7).cast("int"))
    x = lines(spark, sf_dir).select("line_id", "report_id", said.alias("text"))
    basic = M.basic_measurements(x, ["report_id"], ["line_id"]).select("report_id", "name", "value")
    vascular = M.vascular_values(x.withColumn("text", F.col("text")), ["report_id"], ["line_id"]).select("report_id", F.concat_ws(" ", "metric", "side").alias("name"), "value")
    return basic.unionByName(vascular)


def records_with_one_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a member's records with an identifier of one kind and value."""
    i = F.col("event_id")
    ids = F.map_from_arrays(F.array(F.lit("报告号"), F.lit("门诊号")), F.array((F.floor(i / 60) * 7 + 100).cast("string"), F.when(i % 4 == 0, F.concat(F.lit("M"), F.floor(i / 90))).otherwise("12")))
    x = table(spark, sf_dir, "events").select(i.alias("id"), (F.col("user_id") % 9).alias("member"), ids.alias("ids"))
    return U.shared_identifiers(x, "id", "ids", "member").select("a", "b", F.array_join("kinds", ",").alias("kinds"))


def candidates_of_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For reports that are checked for duplicates, the 5 newest others of their member."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 40).alias("member_id"), F.when(k % 7 == 0, "trashed").otherwise("ready").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return U.precheck_candidates(r.filter("id % 15 = 0"), r, 5)


def duplicates_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports: all pairs of different texts that shingles and lines call duplicates, and each text's copies."""
    out = U.near_duplicate_texts(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return out.withColumn("shared_lines", F.coalesce("shared_lines", F.lit(-1)))


def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.floor(i / 4).alias("report_id"), F.when(i % 9 > 0, F.md5("props")).alias("sha"), (i % 4).alias("page"))
    return signature(x, ["report_id"], ["sha", "page"], "sha").select("report_id", F.coalesce("signature", F.lit("")).alias("signature"))


QUERIES = {
    f.__name__: f
    for f in (
        lines_that_support, facts_with_a_source, lines_covered, fields_picked, sections_merged, rows_by_completeness, facts_not_protected, facts_matched_by_hand, facts_folded, results_not_extracted, facts_of_payloads,
        lists_and_maps_of_payloads, contexts_of_lines, lines_without_advice, lines_of_json, results_in_tables, measurements_in_lines, records_with_one_identifier, candidates_of_checks, duplicates_by_text, file_signatures,
    )
}

_BARE_PROOF = lambda x: _gone(f"lower({narrowed(x)})", r"[（）()，,。.:：;；、|\s_\-]+")
_V = "cast(abs(floor(value)) as bigint)"
SUPPORT = f"""{LINES}, fa as (select line_id as fact_id, report_id, page_number, {_BARE_PROOF("case line_id % 3 when 0 then substring(text, 2, 9) when 1 then text || '！？' else '别处' end")} as q, {_BARE_PROOF(_list(NAMES, 'line_id + member_id'))} as n, cast({_V} % 9 + 1 as varchar) as v from lines where line_id % 2 = 0),
  lt as (select line_id, report_id, page_number, line_no, text, {_BARE_PROOF('text')} as t from lines),
  sc as (select fact_id, line_id, line_no, text, case when length(q) >= 4 and (contains(t, q) or contains(q, t)) then 2 when length(n) >= 2 and contains(t, n) and contains(t, v) then 1 else 0 end as score
    from fa join lt using (report_id, page_number) where t <> ''),
  best as (select * from sc where score > 0 qualify row_number() over (partition by fact_id order by score desc, line_no, line_id) <= 3),
  su as (select fact_id, line_id, score from best qualify row_number() over (partition by fact_id, text order by score desc, line_no, line_id) = 1)"""
_ROLE = roles_sql("text")
PAGED = f"pg as (select line_id, report_id as doc_id, page_number as page, line_no, text, {_ROLE['boundary']} as boundary, {_ROLE['candidate']} as candidate from lines)"
_BARE = f"trim({_gone('text', r'^【\\s*|\\s*】$'.replace(chr(92) * 2, chr(92)))})"
_FIRST_LABEL = f"trim({_gone(_gone('trim(regexp_split_to_array(text, ' + chr(39) + '[|｜]' + chr(39) + ')[1])', '^【' + chr(92) + 's*|' + chr(92) + 's*】$'), '[:：]$')})"

SQL = {
    "lines_that_support": f"with {SUPPORT} select fact_id, line_id, score from su",
    "facts_with_a_source": f"""
        with {SUPPORT}, r as (select fact_id, arg_max(line_id, (score, line_id)) as line_id, max(score) as top, count(*) filter (true) as n, list_sort(list(score), 'desc')[2] as second from su group by 1)
        select fact_id, case when n < 2 or top > second then line_id else -1 end as line_id from r
    """,
    "lines_covered": f"""
        with {SUPPORT}, c as (select line_id, event_type, line_id in (select line_id from su) as ai, line_id % 5 < 2 as mine from lines where {_ROLE['candidate']}),
        o as (select line_id, event_type, case when ai and mine then 'redundant' when mine then 'local' when ai then 'ai' else 'unresolved' end as outcome from c)
        select line_id, outcome, case when outcome = 'unresolved' then cast(floor((row_number() over (partition by outcome, event_type, line_id // 4 order by line_id) - 1) / 2) as integer) else -1 end as block from o
    """,
    "fields_picked": "select event_id // 20 as report_id, event_type as field, arg_max('v' || event_id, (event_id * 7 % 5, -event_id)) as value from events where event_id % 4 > 0 group by 1, 2",
    "sections_merged": """
        with x as (select event_id // 12 as report_id, event_type as k, event_id % 3 as t, min(event_id) as p from events group by 1, 2, 3),
        e as (select event_id // 12 as report_id, event_type as k, unnest([cast(event_id % 2 as varchar), cast(user_id as varchar)]) as e from events where event_id % 4 > 0)
        select report_id, k as section_key, string_agg('t' || t, '/' order by p) as content, coalesce((select string_agg(distinct e.e, ',' order by e.e) from e where e.report_id = x.report_id and e.k = x.k), '') as evidence,
          (select max(event_id % 9 / 10) from events where event_id // 12 = x.report_id and event_type = x.k) as confidence from x group by 1, 2
    """,
    "rows_by_completeness": "select event_id, (event_id % 2)::int + (event_id % 3 = 0)::int + (coalesce(props, '') <> '')::int as filled from events",
    "facts_not_protected": """
        with x as (select event_id as f, event_id // 30 as r, event_id * 3 % 17 as n, [cast(event_id % 19 as varchar), cast(event_id * 5 % 23 as varchar)] as e, event_type = 'signup' as m from events)
        select f as fact_id from x where not m and not exists (select 1 from x y where y.m and y.r = x.r and (y.n = x.n or len(list_intersect(y.e, x.e)) > 0))
    """,
    "facts_matched_by_hand": """
        with x as (select event_id as f, event_id // 25 as r, event_id * 7 % 13 as n, event_type as t from events),
        b as (select a.f, m.f as m, 70.0 - 3 * abs(a.n - m.n) as s from x a join x m on m.r = a.r where a.t = 'click' and m.t = 'purchase' and 70.0 - 3 * abs(a.n - m.n) >= 52),
        k as (select * from b qualify rank() over (partition by f order by s desc) = 1), l as (select * from k qualify count(*) over (partition by f) = 1)
        select f as fact_id, m as manual_id from l qualify row_number() over (partition by m order by s desc, f) = 1
    """,
    "facts_folded": """
        with x as (select event_id // 15 as r, event_type as n, case when event_id % 3 > 0 then 'u' || event_id * 5 % 4 end as u, event_id as p from events),
        g as (select r, n, min(p) as first, arg_min(u, p) as u1 from x group by 1, 2), k as (select r, n, u, min(p) as p from x where u is not null group by 1, 2, 3)
        select r as report_id, n as name, u as unit, case when u = u1 and first < p then first else p end as position from k join g using (r, n) union all select r, n, '', first from g where u1 is null
    """,
    "results_not_extracted": """
        with x as (select event_id as f, event_id // 40 as r, event_id % 5 as a, event_id % 7 as b, event_id % 3 as s, event_id // 2 % 2 as p, user_id % 3 as q from events)
        select f as fact_id from x where f % 2 = 0 and not exists (select 1 from x y where y.f % 2 = 1 and y.r = x.r and y.s = x.s and y.p = x.p and y.q = x.q and (y.a = x.a or y.b = x.b))
    """,
    "facts_of_payloads": """
        select event_id, 0 as position, 'Name' as "itemName", value as number, case when event_id % 2 = 0 then 'high' else '' end as flag, 80 as unit_length, 3 as page, 'said' as quote from events where event_id % 11 > 0
        union all select event_id, 1, 'n' || user_id, -1, 'low', 0, 3, 'q' || user_id from events where event_id % 11 > 0
    """,
    "lists_and_maps_of_payloads": """
        select event_id, case when event_id % 4 = 0 then 2 else 0 end as n, '{"keep":"x' || user_id || '"}' as map, case when event_id % 5 = 0 then user_id + 0.5 else -1 end as total, case when event_id % 5 = 1 then 'A1' else '' end as invoice,
          case event_id % 5 when 0 then 'USD' when 1 then 'CNY' else '' end as currency from events
    """,
    "contexts_of_lines": f"""
        with {LINES}, {PAGED}, e as (select doc_id, page, arg_min(candidate, line_no) as f, arg_max(candidate, line_no) as l from pg group by 1, 2),
        n as (select doc_id, page, coalesce(page = lag(page) over w + 1 and lag(l) over w and f, false) as follows from e window w as (partition by doc_id order by page)),
        r as (select doc_id, page, sum(case when follows then 0 else 1 end) over (partition by doc_id order by page) as run from n),
        s as (select pg.*, run, sum(case when boundary = 'section' then 1 else 0 end) over (partition by doc_id, run order by page, line_no) as part from pg join r using (doc_id, page))
        select doc_id, page, line_no, coalesce(last_value(case when boundary = 'section' then text end ignore nulls) over (partition by doc_id, run order by page, line_no), '') as section,
          coalesce(last_value(case when boundary = 'table_header' then text end ignore nulls) over (partition by doc_id, run, part order by page, line_no), '') as header from s
    """,
    "lines_without_advice": f"""
        with {LINES}, {PAGED}, a as (select *, row_number() over (partition by doc_id, page order by line_no) as at_, {_has('trim(text)', L.EDUCATION_HEADING)} as head,
            coalesce(boundary = 'table_header', false) or {_has('trim(text)', L.CONTENT_RESTART)} or {_has(_FIRST_LABEL, L.SUMMARY_HEADING)} as again, {_has(_BARE, L.HISTORICAL_SECTION)} as old from pg),
        p as (select doc_id, page, bool_or(at_ <= 5 and head) and not bool_or(coalesce(boundary = 'table_header', false)) as starts, bool_or(at_ <= 12 and again) as again, min(at_) filter (old) as old_at from a group by 1, 2),
        s as (select *, coalesce(last_value(case when starts then true when again then false end ignore nulls) over (partition by doc_id order by page), false) as advice from p)
        select line_id from a join s using (doc_id, page) where case when advice then starts and at_ <= 10 and head else old_at is null or at_ < old_at end
    """,
    "lines_of_json": f"""
        with {LINES} select line_id as page_id, case when line_id % 3 = 0 then 'L' || line_id else 'p' || page_number || 'l1' end as line_id, 0 as line_no, sha256(trim(text)) as text, round(least(line_id % 5 / 3, 1.0), 4) as confidence from lines where trim(text) <> ''
    """,
    "results_in_tables": f"""
        with {LINES}, q as (select line_id, {_V} % 9 + 1 as q from lines where line_id % 7 > 0 and line_id % 11 > 0 and line_id % 10 > 0)
        select line_id, ['白细胞', '尿蛋白', '血糖'][line_id % 3 + 1] as item_name, case line_id % 3 when 0 then q || '.5 ↑' when 1 then '阴性' else q || ' mmol/L' end as result_text, case line_id % 3 when 0 then q + 0.5 when 1 then -1 else q end as number,
          ['10^9/L', '', 'mmol/L'][line_id % 3 + 1] as unit, case line_id % 3 when 0 then 3.5 else -1 end as low, case line_id % 3 when 0 then 9.5 when 1 then -1 else 6.1 end as high, case line_id % 3 when 0 then 'high' else '' end as flag from q
    """,
    "measurements_in_lines": f"""
        with {LINES}, v as (select line_id, report_id, {_V} as q from lines),
        m as (select report_id, line_id, unnest(case line_id % 7 when 0 then [{{'n': '身高', 'v': q % 400 + 0.0::double}}] when 1 then [{{'n': '体重', 'v': 60.5::double + q % 9}}] when 2 then [{{'n': '收缩压', 'v': 0.0::double + cast('1' || (q % 90 + 10) as int)}}, {{'n': '舒张压', 'v': q % 60 + 50.0::double}}]
            when 3 then [{{'n': '体重指数', 'v': 20.0::double + q % 9}}] when 5 then [{{'n': 'abi right', 'v': cast('1.' || q % 9 as double)}}] when 6 then [{{'n': 'bapwv left', 'v': 0.0::double + q % 30 * 100}}] end) as m from v)
        select report_id, m.n as name, arg_min(m.v, line_id) as value from m where case m.n when '身高' then m.v between 30 and 250 when 'bapwv left' then m.v between 100 and 5000 when '收缩压' then m.v between 50 and 280 else true end group by 1, 2
    """,
    "records_with_one_identifier": """
        with k as (select event_id as id, user_id % 9 as m, '报告号' as k, cast(event_id // 60 * 7 + 100 as varchar) as v from events union all select event_id, user_id % 9, '门诊号', case when event_id % 4 = 0 then 'M' || event_id // 90 else '12' end from events)
        select x.id as a, y.id as b, string_agg(distinct x.k, ',' order by x.k) as kinds from k x join k y on x.m = y.m and x.k = y.k and x.v = y.v and x.id < y.id where length(x.v) >= 3 group by 1, 2
    """,
    "candidates_of_checks": """
        with r as (select o_orderkey as id, o_custkey % 40 as m, o_orderkey % 7 = 0 as gone, o_orderdate as u from orders)
        select x.id as a, y.id as b from r x join r y on y.m = x.m and y.id <> x.id and not y.gone where x.id % 15 = 0 qualify row_number() over (partition by x.id order by y.u desc, y.id) <= 5
    """,
    "duplicates_by_text": """
        with t as (select doc_id, text, min(doc_id) over (partition by text) as a from documents where length(text) >= 120),
        r as (select doc_id, text, length(text) as n, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) as l from t where doc_id = a),
        sh as (select distinct doc_id, substring(text, i, 7) as s from (select doc_id, text, unnest(range(1, n - 5)) as i from r)),
        c as (select doc_id, count(*) as m from sh group by 1),
        x as (select s1.doc_id as a, s2.doc_id as b, count(*) as k from sh s1 join sh s2 on s1.s = s2.s and s1.doc_id < s2.doc_id group by 1, 2),
        p as (
          select a, b, least(ra.n, rb.n) / greatest(ra.n, rb.n) as ratio, k / least(ca.m, cb.m) as t_min, k / greatest(ca.m, cb.m) as t_max,
            len(list_intersect(ra.l, rb.l)) as ln, len(list_intersect(ra.l, rb.l)) / least(len(ra.l), len(rb.l)) as l_min, len(list_intersect(ra.l, rb.l)) / greatest(len(ra.l), len(rb.l)) as l_max
          from x join r ra on ra.doc_id = a join r rb on rb.doc_id = b join c ca on ca.doc_id = a join c cb on cb.doc_id = b
          where k >= 0.78 * least(ca.m, cb.m)
        ), e as (
          select a, b, case
            when ratio >= 0.78 and t_min >= 0.92 and t_max >= 0.72 and (ln >= 3 and l_min >= 0.35 or t_min >= 0.985 and t_max >= 0.95) then 'high'
            when ln >= 8 and l_min >= 0.85 and l_max >= 0.6 and t_min >= 0.78 then 'high'
            when ratio >= 0.65 and t_min >= 0.82 and t_max >= 0.55 and ln >= 4 then 'medium' end as confidence, round(t_min, 4) as similarity, ln as shared_lines
          from p
        )
        select a, b, confidence, similarity, cast(shared_lines as integer) as shared_lines from e where confidence is not null
        union all select a, doc_id, 'same', 1.0, -1 from t where doc_id <> a
    """,
    "file_signatures": """
        select event_id // 4 as report_id, case when bool_and(event_id % 9 > 0) then string_agg(md5(props) || ':' || event_id % 4, '|' order by md5(props) || ':' || event_id % 4) else '' end as signature from events group by 1
    """,
}
