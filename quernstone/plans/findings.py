"""Queries over findings of reports: descriptors, timelines, what can be tracked.

The findings are derived from ``events``: each event is a finding of a member's report, put together from a few words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import report_rules as R
from quernstone.operators import edits as E
from quernstone.operators import findings as O
from quernstone.operators import screening as S
from quernstone.operators.views import comparable_series, series_name
from quernstone.sources.tables import spread

from .lines import _cut, _gone, _has, _q, narrowed, roles_sql
from .tables import table

# Words that findings are made of.
ORGAN = ("甲状腺", "肝脏", "", "左肾", "乳腺", "胆囊")
REGION = (None, "左叶", "上极", "2点钟", None, "")
SIDE = ("left", None, "unspecified", "right", None, "bilateral", "unspecified")
KIND = ("结节", "囊肿", "结石", "", "回声")
NAME = ("甲状腺左叶结节", "肝右叶囊肿", "检查发现", "双侧乳腺增生", "胆囊壁毛糙", "肾结石", "脾脏大小正常")
RAW = ("左叶见低回声结节", "未见明显异常", "右侧 1.2×0.8cm 囊肿", None, "大小形态正常", "2022-03-05 复查：肝囊肿较前增大 3×4 mm", "血清检查 本次未见结节")


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values)).cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    return spread(e.select(
        i.alias("id"), F.floor(i / 3).alias("report_id"), (u % 12).alias("member_id"), _pick(ORGAN, i * 5 + u).alias("organ"), _pick(REGION, i + u * 2).alias("region"), _pick(SIDE, i * 3 + u).alias("laterality"),
        _pick(KIND, i + u).alias("finding_type"), _pick(NAME, i * 2 + u).alias("finding_name"), _pick(RAW, i * 4 + u).alias("raw_text"), F.when(i % 7 == 0, "absent").otherwise("present").alias("presence"),
        F.when(i % 4 != 1, F.round(F.abs("value"), 1)).alias("size_mm"), F.when(i % 5 == 2, _pick(("2", "3", "4a"), i + u)).alias("classification"), _pick(RAW, i).alias("description"), F.date_format("ts", "yyyy-MM-dd").alias("report_date"),
    ))


def finding_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organ, type, side and region of each finding by the rules, its tracking id, and whether it can be tracked."""
    d = O.descriptors(findings(spark, sf_dir))
    text = O._said(F.col("finding_name"), F.col("finding_type"), F.col("raw_text"), F.col("description"))
    return d.select(
        "id", *[F.coalesce(f"d_{c}", F.lit("")).alias(c) for c in ("organ", "type", "side", "region")],
        O.tracking_id(F.col("member_id").cast("string"), *[F.col(f"d_{c}") for c in ("organ", "type", "side", "region")]).alias("tracking_id"),
        O.is_trackable(F.col("finding_name"), F.col("finding_type"), F.col("raw_text"), F.col("description"), F.col("presence")).alias("trackable"), O.is_generic_normal(text).alias("generic"),
    )


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.link_findings(findings(spark, sf_dir))


def linked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their timelines; sides and regions that the member's others settle are taken from them."""
    return _linked(spark, sf_dir).select("id", F.coalesce("group_id", F.lit("")).alias("group_id"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def finding_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.timelines(_linked(spark, sf_dir))


def tracking_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _linked(spark, sf_dir)
    return O.tracking_summary(linked).select("groups", "multi_report_groups", "findings").join(O.rebuild_counters(linked).select("scanned", "linked", "untracked", "ambiguous", "members"))


def shown_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines of several reports whose words hold a keyword, with their names."""
    linked = _linked(spark, sf_dir)
    name = series_name(F.col("d_side"), F.col("d_organ"), F.col("d_region"), F.col("d_type"))
    per = linked.filter("group_id is not null").groupBy("group_id").agg(F.count_distinct("report_id").alias("n_reports"), F.min(F.struct("d_side", "d_organ", "d_region", "d_type")).alias("d")).select("group_id", "n_reports", "d.*")
    return O.shown_timelines(per.withColumn("name", name), "multi", " 结节 ").select("group_id", "n_reports", "name")


def series_that_may_be_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a member's timelines whose sides don't conflict and whose organ or type is equal."""
    linked = _linked(spark, sf_dir).filter("group_id is not null")
    per = linked.groupBy("member_id", "group_id").agg(F.min("d_side").alias("side"), F.min("d_organ").alias("organ"), F.min("d_type").alias("type"))
    return comparable_series(per)


def findings_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that are findings in truth, as findings; the rest is counted by the other query."""
    return _moved(spark, sf_dir, True)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return findings(spark, sf_dir).select(
        "id", "report_id", F.when(i % 3 == 0, "超声检查").when(i % 3 == 1, "血常规").alias("section_name"), F.col("finding_name").alias("item_name"), F.coalesce("raw_text", F.lit("阴性")).alias("result_text"),
        F.when(i % 2 == 0, F.col("size_mm")).alias("numeric_value"), F.when(i % 4 == 0, "mm").alias("unit"), F.lit(None).cast("string").alias("reference_text"), F.when(i % 6 == 0, F.concat(F.lit("左侧"), "finding_name")).alias("quote"),
    )


def _moved(spark: SparkSession, sf_dir: str, findings_: bool) -> DataFrame:
    moved, _ = S.split_legacy(_observations(spark, sf_dir))
    out = E.findings_from_observations(moved)
    return out.select("report_id", F.coalesce("organ", F.lit("")).alias("organ"), "laterality", "finding_type", "finding_name", "presence", F.coalesce("size.length", F.lit(-1.0)).alias("length"), "raw_text")


def observation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When and from what an observation is, for those that stay observations."""
    _, rest = S.split_legacy(_observations(spark, sf_dir))
    c = E.observation_context(F.col("section_name"), F.col("item_name"), F.col("result_text"), F.lit(None).cast("string"), F.array(F.coalesce("quote", F.lit(""))))
    return rest.select("id", c.alias("c")).select("id", "c.temporal", F.coalesce("c.measured_at", F.lit("")).alias("measured_at"), F.coalesce("c.specimen", F.lit("")).alias("specimen"))


def findings_after_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines after people linked every 10th finding to a group of theirs and put every 15th on its own, kept over a rebuild."""
    linked = _linked(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "group_id", F.array().cast("array<string>").alias("manual_fields"))
    i = F.col("id").cast("long")
    links = linked.filter(i % 10 == 0).select("id", F.lit("mine").alias("group_id"), F.lit(1).alias("at")).unionByName(linked.filter(i % 15 == 0).select("id", F.lit(None).cast("string").alias("group_id"), F.lit(2).alias("at")))
    kept = E.keep_manual_links(E.relink(linked, links), linked.select("id", "group_id"))
    return kept.select("id", F.coalesce("group_id", F.lit("")).alias("group_id"))


QUERIES = {
    f.__name__: f
    for f in (finding_descriptors, linked_findings, finding_timelines, tracking_counters, shown_timelines, series_that_may_be_one, findings_moved, observation_contexts, findings_after_links)
}


def _list(values: tuple, at: str) -> str:
    return f"[{', '.join('null' if v is None else _q(v) for v in values)}][({at}) % {len(values)} + 1]"


def _first(x: str, rules: tuple, default: str = "null") -> str:
    return "case " + " ".join(f"when {_has(x, p)} then {_q(label)}" for p, label in rules) + f" else {default} end"


def _compact(x: str) -> str:
    return _gone(f"lower({narrowed(f'coalesce({x}, chr(32))')})", r"[（）()【】\[\]，,。.:：;；、\s_-]+")


_I, _U = "event_id", "user_id"
FINDINGS = f"""f as (select event_id as id, event_id // 3 as report_id, user_id % 12 as member_id, {_list(ORGAN, 'event_id * 5 + user_id')} as organ, {_list(REGION, 'event_id + user_id * 2')} as region,
    {_list(SIDE, 'event_id * 3 + user_id')} as laterality, {_list(KIND, 'event_id + user_id')} as finding_type, {_list(NAME, 'event_id * 2 + user_id')} as finding_name, {_list(RAW, 'event_id * 4 + user_id')} as raw_text,
    case when event_id % 7 = 0 then 'absent' else 'present' end as presence, case when event_id % 4 <> 1 then round(abs(value), 1) end as size_mm,
    case when event_id % 5 = 2 then {_list(('2', '3', '4a'), 'event_id + user_id')} end as classification, {_list(RAW, 'event_id')} as description, strftime(ts, '%Y-%m-%d') as report_date from events),
  g as (select *, concat_ws(' ', organ, region, finding_type, finding_name) as ident, substring(coalesce(raw_text, ''), 1, 500) as raw from f),
  d as (select *, coalesce({_first("trim(coalesce(nullif(organ, ''), ident))", R.ORGANS)}, {_first("trim(finding_name)", R.ORGANS)}, {_first("trim(concat_ws(' ', ident, raw))", R.ORGANS)}) as d_organ,
    coalesce({_first("trim(concat_ws(' ', finding_type, finding_name))", R.FINDING_TYPES)}, {_first("trim(raw)", R.FINDING_TYPES)}) as d_type,
    case when coalesce(laterality, 'unspecified') <> 'unspecified' then laterality else {_first("ident", R.SIDES, "'unspecified'")} end as d_side,
    {_gone("coalesce(" + ", ".join(f"nullif({_cut('src', p)}, '')" for p in R.REGIONS) + ")", r"\s+")} as d_region from (select *, concat_ws(' ', coalesce(region, ''), ident) as src from g))"""
_ID = lambda *c: "'morph_' || substring(sha256(" + " || '|' || ".join(_compact(x) for x in c) + "), 1, 24)"
LINKED = f"""{FINDINGS},
  s1 as (select member_id, d_organ, d_type, count(distinct nullif(d_side, 'unspecified')) as sn, min(nullif(d_side, 'unspecified')) as sv from d group by 1, 2, 3),
  s2 as (select d.*, case when d_side <> 'unspecified' then d_side when sn = 1 then sv when coalesce(sn, 0) = 0 then 'unspecified' end as side from d left join s1 using (member_id, d_organ, d_type)),
  r1 as (select member_id, d_organ, d_type, side, count(distinct d_region) as rn, min(d_region) as rv from s2 group by 1, 2, 3, 4),
  r2 as (select s2.*, coalesce(d_region, case when rn = 1 then rv end) as reg, d_region is null and coalesce(rn, 0) > 1 as many from s2 left join r1 using (member_id, d_organ, d_type, side)),
  k as (select *, d_organ is not null and d_type is not null as known, side is null or many as open from r2),
  g1 as (select *, case when known and not open then {_ID('cast(member_id as varchar)', 'd_organ', 'd_type', 'side', 'reg')} end as g from k),
  c1 as (select g, report_id, count(distinct round(size_mm, 1)) > 1 as bad from g1 where g is not null group by 1, 2),
  linked as (select g1.*, case when not coalesce(bad, false) then g end as group_id, known and (open or coalesce(bad, false)) as ambiguous from g1 left join c1 using (g, report_id))"""
_SAID = narrowed("concat_ws(' ', finding_name, finding_type, raw_text, description)")
_GENERIC = f"({_has(_SAID, R.GENERIC_NORMAL)} and not {_has(_SAID, R.TRACKABLE)})"
_RICH = "(size_mm is not null)::int + (classification is not null)::int + (description is not null)::int"
OBSERVED = f"""{FINDINGS}, o as (select id, report_id, case id % 3 when 0 then '超声检查' when 1 then '血常规' end as section_name, finding_name as item_name, coalesce(raw_text, '阴性') as result_text,
    case when id % 2 = 0 then size_mm end as numeric_value, case when id % 4 = 0 then 'mm' end as unit, case when id % 6 = 0 then '左侧' || finding_name end as quote from f),
  m as (select *, {roles_sql("concat_ws(' ', section_name, item_name, result_text)")['morphology']} or (numeric_value is null and unit is null and coalesce({_has('section_name', '超声|彩超|影像|CT|MRI|磁共振|放射|病理|内镜')}, false)) as moved from o)"""
_TEXT = "concat_ws(' ', section_name, item_name, result_text, coalesce(quote, ''))"
_SIZED = r"(\d+(?:\.\d+)?)\s*(?:(mm|cm|毫米|厘米)\s*)?[×xX*＊]\s*(\d+(?:\.\d+)?)"

SQL = {
    "finding_descriptors": f"""
        with {FINDINGS} select id, coalesce(d_organ, '') as organ, coalesce(d_type, '') as type, d_side as side, coalesce(d_region, '') as region,
          {_ID('cast(member_id as varchar)', 'd_organ', 'd_type', 'd_side', 'd_region')} as tracking_id, {_GENERIC} as generic,
          {_SAID} <> '' and not {_GENERIC} and not ({_has("trim(coalesce(finding_name, ''))", R.PLACEHOLDER)} and {_has("trim(coalesce(finding_type, ''))", R.PLACEHOLDER)})
            and case when presence = 'absent' then {_has(_SAID, R.TRACKABLE_ABSENT)} else {_has(_SAID, R.TRACKABLE)} end as trackable
        from d
    """,
    "linked_findings": f"with {LINKED} select id, coalesce(group_id, '') as group_id, ambiguous from linked",
    "finding_timelines": f"""
        with {LINKED}, one as (select * from linked where group_id is not null qualify row_number() over (partition by group_id, report_id order by {_RICH} desc, coalesce(size_mm, -1) desc, id) = 1),
        p as (select *, lag(id) over w as p_id, lag(presence) over w as pp, lag(classification) over w as pc, lag(size_mm) over w as ps, lag(coalesce(description, '')) over w as pd, count(*) over (partition by group_id) as n,
          row_number() over (partition by group_id order by report_date desc, report_id desc) as r from one window w as (partition by group_id order by report_date, report_id))
        select group_id, n as n_reports, report_date as latest_date, size_mm as latest_mm, ps as previous_mm, round(size_mm - ps, 3) as delta_mm,
          case when p_id is null then 'first' when pp <> 'absent' and presence = 'absent' then 'resolved' when pp = 'absent' and presence <> 'absent' then 'appeared' when classification <> pc then 'classification_changed'
            when size_mm - ps > greatest(1.0, abs(ps) * 0.05) then 'increased' when ps - size_mm > greatest(1.0, abs(ps) * 0.05) then 'decreased' when size_mm is not null and ps is not null then 'stable'
            when coalesce(description, '') <> pd then 'description_changed' else 'stable' end as change
        from p where r = 1
    """,
    "tracking_counters": f"""
        with {LINKED}, per as (select group_id, count(distinct report_id) as reports, count(*) as n from linked where group_id is not null group by 1)
        select (select count(*) from per) as groups, (select count(*) from per where reports > 1) as multi_report_groups, (select cast(sum(n) as bigint) from per) as findings, count(*) as scanned, count(group_id) as linked,
          count(*) filter (group_id is null) as untracked, count(*) filter (ambiguous) as ambiguous, count(distinct member_id) as members from linked
    """,
    "shown_timelines": f"""
        with {LINKED}, per as (select group_id, count(distinct report_id) as n_reports, arg_min({{'s': d_side, 'o': d_organ, 'r': d_region, 't': d_type}}, (d_side, d_organ, coalesce(d_region, ''), d_type)) as d from linked where group_id is not null group by 1),
        n as (select group_id, n_reports, d.o as o, d.r as r, d.t as t, case when substring(d.o, 1, 1) in ('左', '右', '双') then '' else case d.s when 'left' then '左侧' when 'right' then '右侧' when 'bilateral' then '双侧' else '' end end as side,
          case when d.r is null or contains(d.o, d.r) then d.o else d.o || d.r end as place from per)
        select group_id, n_reports, side || place || case when contains(place, t) then '' else t end as name from n
        where n_reports > 1 and contains(lower(concat_ws(' ', side || place || case when contains(place, t) then '' else t end, o, r, t)), '结节')
    """,
    "series_that_may_be_one": f"""
        with {LINKED}, per as (select member_id, group_id, min(d_side) as side, min(d_organ) as organ, min(d_type) as type from linked where group_id is not null group by 1, 2)
        select x.group_id as a, y.group_id as b from per x join per y on x.member_id = y.member_id and x.group_id < y.group_id and (x.organ = y.organ or x.type = y.type)
        where not (x.side <> y.side and x.side not in ('unspecified', 'bilateral') and y.side not in ('unspecified', 'bilateral'))
    """,
    "findings_moved": f"""
        with {OBSERVED}, t as (select *, concat_ws(' ', item_name, result_text) as said, coalesce(quote, item_name || '：' || result_text) as raw from m where moved)
        select report_id, coalesce({_first('said', R.ORGANS)}, '') as organ, {_first('raw', R.SIDES, "'unspecified'")} as laterality, {_first('said', R.FINDING_TYPES, "'形态发现'")} as finding_type, item_name as finding_name,
          case when {_has('result_text', '未见|未发现|无明显')} then 'absent' else 'present' end as presence, coalesce(try_cast(nullif({_cut('result_text', _SIZED, 1)}, '') as double), -1) as length, raw as raw_text from t
    """,
    "observation_contexts": f"""
        with {OBSERVED} select id, case when {_has(_TEXT, E.HISTORICAL)} and not {_has(_TEXT, E.CURRENT)} then 'historical' else 'current' end as temporal,
          coalesce(nullif({_cut(_TEXT, r'\b20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:日)?(?:\s+\d{1,2}[:：]\d{2})?')}, ''), nullif({_cut(_TEXT, r'\b\d{1,2}[:：]\d{2}\b')}, ''), '') as measured_at, {_first(_TEXT, E.SPECIMENS, "''")} as specimen
        from m where not moved
    """,
    "findings_after_links": f"""
        with {LINKED} select cast(id as varchar) as id, case when id % 15 = 0 then 'morph_own_' || substring(sha256(cast(id as varchar)), 1, 20) when id % 10 = 0 then 'mine' else coalesce(group_id, '') end as group_id from linked
    """,
}
