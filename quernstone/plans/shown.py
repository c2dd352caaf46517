"""Queries in the shape of what is shown and kept: rollups, labels, logs, titles, the dictionary, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import aggregates as A
from quernstone.operators import dictionary as D
from quernstone.operators import listing as G
from quernstone.operators import reports as P
from quernstone.operators import screening as S
from quernstone.operators import views as V
from quernstone.sources import sinks as K
from quernstone.sources.tables import row_counts

from .findings import _list, _pick
from .lines import LINES, _gone, _has, lines, narrowed
from .tables import table


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def sections_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as series by brand and type: how many there are, and how many need attention."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("group"), F.col("p_type").alias("subgroup"), F.concat_ws("-", "p_name", "p_partkey").alias("name"), F.col("p_partkey").alias("series_key"), F.when(F.col("p_size") < 10, "abnormal").otherwise("none").alias("level")
    )
    out = V.sections(p)
    return out.select("group", "n", "abnormal", F.array_join(F.transform("subgroups", lambda x: F.concat_ws(":", x["subgroup"], x["n"], x["abnormal"], F.size(x["keys"]), x["keys"][0])), "|").alias("subgroups"))


def issues_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = _e(spark, sf_dir).select(F.concat(F.lit("n"), i % 50).alias("name"), F.lit(1).alias("n"), F.when(i % 3 > 0, F.concat(F.lit("u"), i % 4)).alias("unit"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("section_name"), F.date_format("ts", "yyyy-MM-dd").alias("latest"))
    return V.issues(x).select("name", "n", F.array_join("units", ",").alias("units"), F.array_join("sections", ",").alias("sections"), "latest")


def jobs_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction of each report in one row: events are attempts, orders units with one to three pages."""
    i = F.col("event_id")
    attempts = _e(spark, sf_dir).select((i % 400).alias("report_id"), i.alias("unit_id"), F.when(i % 5 > 0, i % 900).alias("input_tokens"), (i % 70).alias("output_tokens"), F.round(F.abs("value") * 10).cast("long").alias("elapsed_ms"))
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("queued")
    units = table(spark, sf_dir, "orders").select((k % 450).alias("report_id"), k.alias("unit_id"), state.alias("status"), F.sequence(k % 6, k % 6 + k % 3).alias("pages"))
    return V.job_rollup(attempts, units)


def labels_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = _e(spark, sf_dir).select(F.floor(i / 7).alias("report_id"), F.col("event_type").alias("mode"), (i % 3 == 0).alias("supplement"), (i * 5 % 11).alias("first_page"), (i % 4).alias("unit_index"), i.alias("unit_id"))
    return V.unit_labels(x).select("unit_id", "label")


def audit_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with the names of what their details refer to, and a sentence made of them."""
    i = F.col("event_id")
    detail = F.to_json(F.struct(F.when(i % 3 > 0, (F.col("user_id") * 7 % 170).cast("string")).alias("member"), F.when(i % 2 > 0, F.concat(F.lit("supplier-number-"), F.col("user_id") % 12)).alias("supplier")))
    audit = _e(spark, sf_dir).select("event_id", F.col("event_type").alias("action"), detail.alias("detail_json"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-number-"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    out = V.audit_labels(audit, {"member": (c, "name"), "supplier": (s, "name")})
    return out.select("event_id", V.audit_sentence(F.col("action"), [F.col("member_name"), F.col("supplier_name")]).alias("sentence"))


def important_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a log's warnings and errors: 40 rows behind the row where the first ended."""
    x = _e(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warn").otherwise("info").alias("level"), F.col("props").alias("message"))
    last = V.log_page(x, "important", 40).orderBy("ts", "id").first()
    return V.log_page(x, "important", 40, (last.ts, last.id)).select("id", "level", "kind")


def series_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose name holds a query, else an alias; full-width letters and spaces make no difference."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.split("p_name", " ").alias("names"))
    return S.search_series(p, "Ｒ ing").select("id", F.coalesce("matched_alias", F.lit("")).alias("matched_alias")).unionByName(S.search_series(p, "promo").select("id", F.coalesce("matched_alias", F.lit("")).alias("matched_alias")))


TITLES = ("报告", "血脂四项", None, " 体检 报告 ", "2024年度总结")
KINDS = ("checkup", "laboratory", "imaging", "functional", "pathology", "outpatient", "inpatient", "prescription", "billing", "vaccination", "other")
SUBTYPES = (None, "血常规检验", "CT", "null", "生化报告")
PLACES = ("胸部", None, "腹部")
WARDS = (None, "心内科", "外科病区")


def report_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and subjects of reports' cards."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("id"), _pick(TITLES, k).alias("title"), _pick(KINDS, k + c).alias("kind"), _pick(SUBTYPES, k * 2 + c).alias("subtype"), _pick(PLACES, c).alias("part"), _pick(WARDS, k + c * 2).alias("ward"), F.when(k % 4 == 0, F.lit("内科")).alias("dept"),
        F.when(k % 5 == 0, " ").when(k % 5 == 1, "检验科").alias("lab"),
    )
    f = F.col
    title = P.report_title(f("title"), f("kind"), f("subtype"), f("part"), f("dept"), f("lab"), F.lit(None).cast("string"), f("ward"), F.lit(None).cast("string"), F.lit("流感疫苗"))
    body = P.shown_body_part(f("kind"), f("subtype"), f("part"), f("dept"), f("lab"), F.lit(None).cast("string"), f("ward"))
    dept = P.display_department(P.blank_to_null(f("lab")), f("ward"), F.lit(None).cast("string"), f("dept"), f("kind"))
    return o.select("id", title.alias("title"), F.coalesce(body, F.lit("")).alias("body"), F.coalesce(dept, F.lit("")).alias("department"), P.is_generic_title(f("title")).alias("generic"))


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey") % 900).alias("canonical_key"), F.col("p_brand").alias("category"), "p_partkey")
    core = p.filter("p_partkey % 3 = 0").groupBy("canonical_key").agg(F.max("category").alias("category"))
    remote = p.filter("p_partkey % 2 = 0").groupBy("canonical_key").agg(F.min("category").alias("category"))
    redirects = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey") * 3).alias("from_key"), F.concat(F.lit("k"), (F.col("n_nationkey") + 1) * 3).alias("to_key"))
    return core, remote, redirects


def dictionary_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the core and of the remote layer that are in use, and how many each layer has."""
    merged = D.merge_layers(*_layers(spark, sf_dir))
    n = D.layer_counts(merged).withColumnRenamed("n", "of_layer")
    return merged.join(n, "layer").select("canonical_key", "category", "layer", "of_layer")


def dictionary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a dictionary made of the parts: repeated keys, unknown categories, aliases, places and redirects."""
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    indicators = p.select(F.concat(F.lit("k"), F.when(F.col("p_partkey") % 50 == 1, 0).otherwise(F.col("p_partkey"))).alias("canonical_key"), F.col("p_brand").alias("category"))
    aliases = p.select(F.concat(F.lit("k"), F.col("p_partkey") + F.when(F.col("p_partkey") % 90 == 0, 10**6).otherwise(0)).alias("canonical_key"), F.concat("p_name", F.lit(" "), F.col("p_size")).alias("alias"), F.col("p_type").alias("scope"))
    categories = p.filter("p_brand <> 'Brand#3'").groupBy(F.col("p_brand").alias("category")).agg(F.lit("g").alias("group"), F.min(F.col("p_size") % 2).alias("item_order"))
    to = F.when(F.col("n_nationkey") == 7, -9).when(F.col("n_nationkey") == 12, 10).otherwise(F.col("n_nationkey") + 1)
    redirects = n.filter("n_nationkey < 20").select(F.concat(F.lit("r"), "n_nationkey").alias("from_key"), F.when(F.col("n_nationkey") == 19, "k2").otherwise(F.concat(F.lit("r"), to)).alias("to_key"))
    return D.validate(indicators, aliases, categories, redirects).groupBy("problem").agg(F.count("*").alias("n"), F.min("subject").alias("first"), F.max("subject").alias("last"))


def dictionary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    core, remote, _ = _layers(spark, sf_dir)
    return D.dictionary_diff(core, remote, ["category"]).select("change", "n", F.array_join("keys", ",").alias("keys"))


def entries_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a dictionary that lines mention: codes as words, other names as the first cell or within the text."""
    names = [("wbc", "WBC"), ("wbc", "白细胞计数"), ("hgb", "HGB"), ("tc", "总胆固醇"), ("liver", "肝脏"), ("alt", "谷丙转氨酶"), ("bp", "血压"), ("g", "糖"), ("crp", "CRP")]
    return D.facts_for_lines(lines(spark, sf_dir).select("line_id", "text"), spark.createDataFrame(names, "canonical_key string, alias string")).select("line_id", "canonical_key", "alias")


def sizes_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({t: table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "events", "documents")})


def reports_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with a page whose text holds a word, whatever its case."""
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    pages = table(spark, sf_dir, "documents").select((F.col("doc_id") % 900).alias("report_id"), F.col("text").alias("lines_json"))
    return G.with_page_text(reports, pages, " LICENSED ")


def customers_with_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_keyword(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "House").select("c_custkey", "c_mktsegment")


def pages_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of reports in the order in which they are uploaded: those without a number come last; some have lists of lines."""
    i = F.col("event_id")
    x = _e(spark, sf_dir).select(i.alias("id"), F.floor(i / 12).alias("report_id"), F.when(i % 4 > 0, i * 7 % 5).alias("page"), F.when(i % 3 == 0, "[]").when(i % 3 == 1, '["a"]').when(i % 6 == 2, "{").alias("lines"))
    x = x.withColumn("key", G.page_order(F.col("page"))).withColumn("filled", G.is_filled_list(F.col("lines")))
    return x.selectExpr("id", "row_number() over (partition by report_id order by key, id) as place", "filled")


def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x = _e(spark, sf_dir).select(F.floor(i / 6).alias("report_id"), F.when(i % 3 > 0, i % 80).alias("text_length"), F.when(i % 6 == 0, "[]").when(i % 6 == 3, '["x"]').alias("lines_json"))
    return A.readable_length(x)


def volume_of_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _e(spark, sf_dir).groupBy(F.concat(F.lit("app.log."), F.col("user_id") % 5).alias("name")).agg(F.sum(F.length("props")).alias("bytes"))
    return A.log_volume(x, "app.log.0")


def pages_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the scores of their pages: events of a user, page by page."""
    i = F.col("event_id")
    x = _e(spark, sf_dir).select(F.floor(i / 9).alias("doc_id"), (i % 9 + 1).alias("page"), F.col("event_type").alias("kind"), (i * 3 % 7).cast("double").alias("score"))
    return A.classify_pages(x).select("doc_id", "top", "top_score", F.coalesce("second", F.lit("")).alias("second"), "both")


def reports_that_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders next to each other: what their lines share, and whether that makes them the same."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 6).alias("a"))
    both = x.join(x.select((F.col("l_orderkey") + 1).alias("l_orderkey"), F.col("a").alias("b")), "l_orderkey").withColumn("o", A.overlap(F.col("a"), F.col("b")))
    return both.select("l_orderkey", "o.shared", F.round("o.of_min", 4).alias("of_min"), F.round("o.of_max", 4).alias("of_max"), A.strong_overlap(F.col("o")).alias("strong"))


def first_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), "[ \n]").alias("w"))
    return x.select("conv_id", "turn", F.sha2(F.array_join(A.ordered_distinct(F.col("w"), 3), "|"), 256).alias("words"))


def log_lines_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines fit to be sent away, and texts without labelled lines."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    said = F.get(F.array(F.concat(F.lit("Bearer abc.def-"), u), F.concat(F.lit("api_key: k"), u), F.concat(F.lit("mail a"), u, F.lit("@b.org")), F.concat(F.lit("/home/u"), u, F.lit("/x read")), F.lit("call 13912345678")), (i % 5).cast("int"))
    logs = _e(spark, sf_dir).select("event_id", "user_id", said.alias("message"), F.create_map(F.lit("Api-Key"), u, F.lit("path"), F.concat(F.lit("/root/"), u)).alias("extra"))
    out = K.redacted_bundle(logs).withColumn("u", u)
    whole = F.concat(F.lit("姓名：某某\nkeep "), F.col("u"), F.lit("\n 电话: 1"))
    return out.select("event_id", "message", F.array_join(F.array_sort(F.map_values("extra")), ",").alias("extra"), T.drop_labelled_lines(whole, ["姓名", "电话"]).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        sections_of_series, issues_of_names, jobs_of_reports, labels_of_units, audit_with_names, important_log_page, series_found, report_cards, dictionary_layers, dictionary_problems, dictionary_changes, entries_in_lines, sizes_of_tables,
        reports_with_text, customers_with_keyword, pages_in_order, readable_text, volume_of_logs, pages_classified, reports_that_overlap, first_distinct_words, log_lines_redacted,
    )
}

_GENERIC = "regexp_replace(coalesce(title, ''), '\\s+', '', 'g') in ('', '" + "', '".join(P.GENERIC_TITLES) + "')"
_LAYERS = """p as (select 'k' || p_partkey % 900 as canonical_key, p_brand as category, p_partkey from part),
  core as (select canonical_key, max(category) as category from p where p_partkey % 3 = 0 group by 1), remote as (select canonical_key, min(category) as category from p where p_partkey % 2 = 0 group by 1)"""
_ALIAS = _gone(f"lower({narrowed('alias')})", r"[（）()：:，,。.;；、|\s_-]")

SQL = {
    "sections_of_series": """
        with p as (select p_brand as g, p_type as s, p_name || '-' || p_partkey as name, p_partkey as k, p_size < 10 as a from part),
        s as (select g, s, count(*) as n, count(*) filter (a) as ab, arg_min(k, (name, k)) as k from p group by 1, 2)
        select g as "group", cast(sum(n) as bigint) as n, cast(sum(ab) as bigint) as abnormal, string_agg(s || ':' || n || ':' || ab || ':' || n || ':' || k, '|' order by s) as subgroups from s group by 1
    """,
    "issues_of_names": """
        select 'n' || event_id % 50 as name, count(*) as n, coalesce(string_agg(distinct 'u' || event_id % 4, ',' order by 'u' || event_id % 4) filter (event_id % 3 > 0), '') as units,
          string_agg(distinct 's' || user_id % 3, ',' order by 's' || user_id % 3) as sections, max(strftime(ts, '%Y-%m-%d')) as latest from events group by 1
    """,
    "jobs_of_reports": """
        with a as (select event_id % 400 as report_id, count(*) as attempts, coalesce(sum(case when event_id % 5 > 0 then event_id % 900 end), 0) as it, sum(event_id % 70) as ot, round(sum(cast(round(abs(value) * 10) as bigint)) / 1000, 3) as seconds from events group by 1),
        u as (select o_orderkey % 450 as report_id, o_orderkey as k, o_orderstatus as s from orders),
        p as (select report_id, page, bool_or(s = 'F') as d from (select report_id, s, unnest(range(k % 6, k % 6 + k % 3 + 1)) as page from u) group by 1, 2)
        select report_id, count(*) filter (s = 'F') as done, count(*) filter (s = 'O') as failed, count(*) filter (s = 'P') as open, any_value(pd) as pages_done, any_value(pn) as pages, coalesce(any_value(attempts), 0) as attempts,
          coalesce(any_value(cast(it as bigint)), 0) as input_tokens, coalesce(any_value(cast(ot as bigint)), 0) as output_tokens, coalesce(any_value(seconds), 0) as seconds
        from u left join (select report_id, count(*) filter (d) as pd, count(*) as pn from p group by 1) using (report_id) left join a using (report_id) group by 1
    """,
    "labels_of_units": """
        select event_id as unit_id, event_type || ' ' || row_number() over (partition by event_id // 7, event_type order by event_id % 3 = 0, event_id * 5 % 11, event_id % 4, event_id) as label from events
    """,
    "audit_with_names": """
        select event_id, concat_ws(' · ', event_type, case when event_id % 3 > 0 then coalesce(c_name, cast(user_id * 7 % 170 as varchar)) end, case when event_id % 2 > 0 then coalesce(s_name, 'suppli…' || substring('supplier-number-' || user_id % 12, -4, 4)) end) as sentence
        from events left join customer on c_custkey = user_id * 7 % 170 left join supplier on s_suppkey = user_id % 12
    """,
    "important_log_page": """
        select event_id as id, case event_type when 'error' then 'error' else 'warn' end as level, 'system' as kind from events where event_type in ('error', 'view') order by ts desc, event_id desc limit 40 offset 40
    """,
    "series_found": """
        with p as (select p_partkey as id, lower(p_type) as t, list_filter(string_split(p_name, ' '), lambda n: contains(lower(n), q))[1] as a, q from part, (values ('ring'), ('promo')) v(q))
        select id, case when contains(t, q) then '' else a end as matched_alias from p where contains(t, q) or a is not null
    """,
    "report_cards": f"""
        with o as (select o_orderkey as id, {_list(TITLES, 'o_orderkey')} as title, {_list(KINDS, 'o_orderkey + o_custkey')} as kind, {_list(SUBTYPES, 'o_orderkey * 2 + o_custkey')} as subtype, {_list(PLACES, 'o_custkey')} as part, {_list(WARDS, 'o_orderkey + o_custkey * 2')} as ward,
          case when o_orderkey % 4 = 0 then '内科' end as dept, case o_orderkey % 5 when 0 then ' ' when 1 then '检验科' end as lab from orders),
        m as (select *, {_GENERIC} as generic, coalesce(subtype, lab) as subject, case when subtype = 'null' then null else subtype end as s from o)
        select id, generic, substring(case when not generic then title else case kind when 'checkup' then coalesce(subtype, '综合') || '体检报告'
            when 'laboratory' then case when {_has('subject', '(检验|检查)$')} then subject || '报告' when {_has('subject', '报告$')} then subject else concat_ws('', subject, '检验报告') end
            when 'imaging' then concat_ws('', part, coalesce(subtype, '影像'), '报告') when 'functional' then concat_ws('', coalesce(part, subtype), '功能检查报告') when 'pathology' then concat_ws('', part, '病理报告')
            when 'outpatient' then concat_ws('', dept, '门诊记录') when 'inpatient' then concat_ws('', coalesce(ward, dept), '住院记录') when 'prescription' then concat_ws('', dept, '处方') when 'billing' then '医疗票据'
            when 'vaccination' then '流感疫苗接种记录' else coalesce(subtype, title, '健康报告') end end, 1, 80) as title,
          coalesce(case kind when 'checkup' then coalesce(s, '综合体检') when 'laboratory' then coalesce(s, lab, '检验项目') when 'imaging' then s when 'functional' then coalesce(part, s, '功能检查') when 'pathology' then coalesce(part, s, '病理标本')
            when 'outpatient' then coalesce(dept, '门诊') when 'inpatient' then coalesce(ward, dept, '住院') when 'prescription' then '用药' when 'billing' then '费用' when 'vaccination' then '疫苗接种' else s end, '') as body,
          coalesce(nullif(trim(lab), ''), ward, dept, case when kind = 'checkup' then '综合体检' end, '') as department from m
    """,
    "dictionary_layers": f"""
        with {_LAYERS}, m as (select *, 'core' as layer from core union all select *, 'remote' from remote where canonical_key not in (select canonical_key from core)), k as (select * from m where canonical_key not in (select 'k' || n_nationkey * 3 from nation))
        select *, count(*) over (partition by layer) as of_layer from k
    """,
    "dictionary_problems": f"""
        with i as (select 'k' || case when p_partkey % 50 = 1 then 0 else p_partkey end as k, p_brand as c from part), al as (select 'k' || (p_partkey + case when p_partkey % 90 = 0 then 1000000 else 0 end) as k, p_name || ' ' || p_size as alias, p_type as scope from part),
        cat as (select p_brand as c, min(p_size % 2) as o from part where p_brand <> 'Brand#3' group by 1),
        f as (select 'repeated_key' as problem, k as subject from i group by k having count(*) > 1 union all select 'unknown_category', k from i where c not in (select c from cat) union all select 'unknown_key', alias from al where k not in (select k from i)
          union all select 'ambiguous_alias', {_ALIAS} from al group by {_ALIAS}, scope having count(distinct k) > 1 union all select 'order_clash', 'g#' || o from cat group by o having count(*) > 1 union all select 'redirect_to_nowhere', 'r7'
          union all select 'redirect_circle', 'r' || n_nationkey from nation where n_nationkey between 8 and 12)
        select problem, count(*) as n, min(subject) as first, max(subject) as last from f group by 1
    """,
    "dictionary_changes": f"""
        with {_LAYERS}, d as (select coalesce(r.canonical_key, c.canonical_key) as k, case when c.canonical_key is null then 'added' when r.canonical_key is null then 'removed' when c.category <> r.category then 'updated' end as change from core c full join remote r on c.canonical_key = r.canonical_key)
        select change, count(*) as n, string_agg(k, ',' order by k) as keys from d where change is not null group by 1
    """,
    "entries_in_lines": f"""
        with {LINES}, n(k, a, code) as (values ('wbc', 'WBC', true), ('wbc', '白细胞计数', false), ('hgb', 'HGB', true), ('tc', '总胆固醇', false), ('liver', '肝脏', false), ('alt', '谷丙转氨酶', false), ('bp', '血压', false), ('g', '糖', false), ('crp', 'CRP', true)),
        l as (select line_id, {_has('text', '[|｜]')} as tab, trim(regexp_split_to_array(text, '[|｜]')[1]) as cell, text from lines),
        m as (select line_id, k, a, length(a) as len from l join n on case when code then list_contains(regexp_extract_all(lower({narrowed('cell')}), '[a-z][a-z0-9.+#%]*'), lower(a))
          when tab then {_gone(f"lower({narrowed('cell')})", r'[（）()：:，,。.;；、|\s_-]')} = a else contains({_gone(f"lower({narrowed('text')})", r'[（）()：:，,。.;；、|\s_-]')}, a) end)
        select line_id, k as canonical_key, arg_max(a, (len, a)) as alias from m group by 1, 2 qualify row_number() over (partition by line_id order by length(arg_max(a, (len, a))) desc, k) <= 8
    """,
    "sizes_of_tables": " union all ".join(f"select '{t}' as \"table\", count(*) as n from {t}" for t in ("nation", "customer", "orders", "events", "documents")),
    "reports_with_text": "select o_orderkey as id, o_orderstatus from orders where o_orderkey in (select doc_id % 900 from documents where contains(lower(text), 'licensed'))",
    "customers_with_keyword": "select c_custkey, c_mktsegment from customer where c_name ilike '%house%' or c_mktsegment ilike '%house%'",
    "pages_in_order": """
        select event_id as id, cast(row_number() over (partition by event_id // 12 order by case when event_id % 4 > 0 then event_id * 7 % 5 else 999999 end, event_id) as integer) as place, event_id % 3 = 1 as filled from events
    """,
    "readable_text": "select event_id // 6 as report_id, cast(sum(case when event_id % 3 > 0 then event_id % 80 when event_id % 6 = 3 then 1 else 0 end) as bigint) as n from events group by 1",
    "volume_of_logs": """
        select cast(sum(length(props)) as bigint) as total_bytes, cast(sum(length(props)) filter (user_id % 5 = 0) as bigint) as current_bytes, count(distinct user_id % 5) as files, count(distinct user_id % 5) filter (user_id % 5 <> 0) as archives from events
    """,
    "pages_classified": """
        with s as (select event_id // 9 as doc_id, event_type as kind, round(sum((event_id * 3 % 7) * case when event_id % 9 + 1 <= 2 then 1.4::double else 1.0 end), 6) as t from events group by 1, 2 having t > 0),
        r as (select *, row_number() over (partition by doc_id order by t desc, kind) as r from s)
        select doc_id, max(kind) filter (r = 1) as top, max(t) filter (r = 1) as top_score, coalesce(max(kind) filter (r = 2), '') as second, coalesce(max(t) filter (r = 2) >= greatest(6.0, max(t) filter (r = 1) * 0.55), false) as both from r where r <= 2 group by 1
    """,
    "reports_that_overlap": """
        with x as (select l_orderkey, list(distinct l_suppkey % 6) as a from lineitem group by 1), b as (select x.l_orderkey, x.a, y.a as b, len(list_intersect(x.a, y.a)) as n from x join x y on y.l_orderkey + 1 = x.l_orderkey),
        o as (select l_orderkey, n as shared, n / least(len(a), len(b)) as lo, n / greatest(len(a), len(b)) as hi from b)
        select l_orderkey, shared, round(lo, 4) as of_min, round(hi, 4) as of_max, shared >= 10 or (shared >= 6 and lo >= 0.75 and hi >= 0.3) or (shared >= 3 and lo >= 0.9 and hi >= 0.5) as strong from o
    """,
    "first_distinct_words": r"""
        with w as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[ \n]'), lambda x: trim(x)), lambda x: x <> '') as w from conversations)
        select conv_id, turn, sha256(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:3], '|')) as words from w
    """,
    "log_lines_redacted": """
        select event_id, ['Bearer [redacted]', 'api_key: [redacted]', 'mail [email]', '/home/[path] read', 'call [mobile]'][event_id % 5 + 1] as message, '/root/[path],[redacted]' as extra, 'keep ' || user_id as kept from events
    """,
}
