"""Queries over the lines of documents and facts said to stand in them, taken from the documents' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import folds as W
from quernstone.operators import grounding as G
from quernstone.operators import leaders as D
from quernstone.operators import packing as P
from quernstone.sources.tables import spread

from .tables import table

PAGE = 40


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, report_id, page_number, line_no, text`` of every line of ``documents``."""
    d = spread(table(spark, sf_dir, "documents")).filter("text is not null")
    x = d.select(F.col("doc_id").alias("report_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return x.select((F.col("report_id") * 1_000_000 + F.col("at")).alias("line_id"), "report_id", F.floor(F.col("at") / PAGE).cast("int").alias("page_number"), (F.col("at") % PAGE).alias("line_no"), "text")


def _facts(lines: DataFrame) -> DataFrame:
    """A fact from every seventh line of four words or more: some of its words, a quote from it or around it, or a quote from nowhere."""
    w, i = F.split("text", " "), F.col("line_id")
    x = lines.filter((i % 7 == 0) & (F.size(w) >= 4)).withColumn("w", w)
    word = lambda k: F.get("w", F.lit(k))
    quote = F.when(i % 3 == 0, F.array_join(F.slice("w", 2, 2), " - ")).when(i % 3 == 1, F.concat("text", F.lit(" （zz）"))).otherwise("nowhere at all")
    return x.select(i.alias("fact_id"), "report_id", "page_number", quote.alias("quote"), word(0).alias("name"), word(2).alias("value"), word(1).alias("type"), word(3).alias("organ"), word(2).alias("region"), F.array_join(F.slice("w", 1, 3), ",").alias("raw_text"))


def results_in_lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of its page that show each result."""
    x = document_lines(spark, sf_dir)
    return G.lines_of_results(_facts(x), x)


def findings_in_lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five lines of its page for each finding."""
    x = document_lines(spark, sf_dir)
    return G.lines_of_findings(_facts(x), x)


def facts_in_lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five lines of its page for each clinical fact."""
    x = document_lines(spark, sf_dir)
    return G.lines_of_facts(_facts(x), ["name", "raw_text"], x)


def lines_of_documents_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines some result or finding of their document explains, and how."""
    x = document_lines(spark, sf_dir)
    facts = _facts(x)
    results = facts.filter("fact_id % 2 = 0").withColumn("number", F.when(F.col("fact_id") % 4 == 0, (F.col("fact_id") % 9).cast("string")))
    sizes = F.when(F.col("fact_id") % 5 == 0, F.array((F.col("fact_id") % 10).cast("string"), F.lit("2.5")))
    return G.explained_lines(x, results, facts.filter("fact_id % 2 = 1").withColumn("sizes", sizes))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ``PAGE`` lines of the documents, with their measures: lines with a digit are candidates, those with a bar findings."""
    text = F.col("text")
    x = document_lines(spark, sf_dir).groupBy("report_id", "page_number").agg(
        (F.sum(F.length("text") + 1) - 1).alias("characters"), F.count_if(text.rlike("[0-9]")).alias("candidate_rows"), F.count_if(F.contains(text, F.lit("|"))).alias("morphology_rows"))
    return x.withColumnRenamed("page_number", "place")


def units_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of pages of each document under the limits of tables and findings."""
    return P.pack_pages(_pages(spark, sf_dir), "report_id")


def narrative_units_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of pages of each document under the limits of narratives."""
    return P.pack_pages(_pages(spark, sf_dir), "report_id", P.NARRATIVE)


def units_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as the pages of one long document: a few documents of many pages."""
    d = spread(table(spark, sf_dir, "documents")).select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    return P.pack_pages(d.select("source", "place", F.col("n").alias("characters"), (F.col("n") % 40).alias("candidate_rows"), (F.col("n") % 7).alias("morphology_rows")), "source")


def omission_units_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of the documents as left over, in blocks and units for a second look."""
    x = document_lines(spark, sf_dir).filter("line_id % 3 = 1").withColumn("mode", F.when(F.length("text") % 4 == 0, "morphology").otherwise("scalar"))
    return P.omission_units(x)


def findings_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of events, folded where regions don't contradict and sizes are within half a millimetre."""
    i, v = F.col("event_id"), F.floor(F.abs("value") * 10) % 60 / 10
    x = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 500).alias("report_id"), F.col("event_type").alias("organ"), i.alias("position"), F.when(i % 4 > 0, F.concat(F.lit("region "), i % 2)).alias("region"),
        F.when(i % 3 > 0, F.when(i % 5 > 0, F.array(v + 3, v)).otherwise(F.array(v))).alias("sizes"), F.concat(F.lit("text "), "props").alias("raw_text"))
    out = D.fold_findings(x, ["report_id", "organ"], ["position"], longest=("raw_text",))
    return out.withColumn("sizes", F.coalesce(F.array_join(F.transform("sizes", lambda v: v.cast("decimal(10,1)").cast("string")), ","), F.lit("")))


def results_by_source_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of events, folded by the first of their sources that is known."""
    i = F.col("event_id")
    keys = F.array_compact(F.array(F.when(i % 5 > 0, F.concat(F.lit("line "), F.floor(i / 300))), F.when(i % 7 > 2, F.concat(F.lit("quote "), F.abs(F.floor("value")) % 40))))
    x = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("report_id"), F.col("event_type").alias("name"), i.alias("position"), keys.alias("keys"), F.when(i % 3 == 0, F.concat(F.lit("u"), i % 9)).alias("unit"))
    return D.fold_by_first_key(x, ["report_id", "name"], ["position"], "keys").withColumn("keys", F.array_join("keys", ","))


def visual_rows_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cells put together from boxes: four words of a page's text are a cell, and every fifth cell stands half a line lower."""
    html = spread(table(spark, sf_dir, "pages")).select("page_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "\n"), "\n")).alias("j", "line"))
    words = html.filter(F.trim("line") != "").select("page_id", "j", F.split(F.trim("line"), " +").alias("w"))
    k, j = F.col("k"), F.col("j")
    cells = words.select("page_id", "j", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(4)), lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("k", "text"))
    top = j * 20 + k % 3 + F.when(k % 5 == 4, 10).otherwise(0)
    boxes = cells.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), (j * 100_000 + k).alias("line_id"), "text", (0.5 + k % 5 / 10).alias("confidence"), (k * 100.0).alias("left"), top.alias("top"), (k * 100.0 + 90).alias("right"), (top + 16).alias("bottom"))
    return W.visual_rows(boxes).select(F.col("doc_id").alias("page_id"), "row_no", "text", F.round("confidence", 6).alias("confidence"), "left", "top", "right", "bottom", F.size("line_ids").alias("n_cells"))


def wrapped_lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with those that a page broke put together."""
    x = document_lines(spark, sf_dir).withColumn("boundary", F.lit(None).cast("string"))
    return W.merge_wrapped(x, "report_id", "page_number").select("report_id", "page_number", "line_no", F.md5("text").alias("text_md5"), F.size("line_ids").alias("n_lines"))


def budgets_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that a budget of 2,000 characters has room for, by priority."""
    x = document_lines(spark, sf_dir).select("report_id", (F.length("text") % 5).alias("priority"), F.col("line_id").alias("line_no"), "text")
    return W.fill_budget(x, "report_id", 2000).select("report_id", "line_no", F.length("text").alias("size"))


QUERIES = {f.__name__: f for f in (visual_rows_of_pages, wrapped_lines_of_documents, budgets_of_documents, units_of_documents, narrative_units_of_documents, units_of_sources, omission_units_of_documents, findings_within_tolerance, results_by_source_line, results_in_lines_of_documents, findings_in_lines_of_documents, facts_in_lines_of_documents, lines_of_documents_explained)}

_BARE = lambda x: f"regexp_replace(lower(translate(coalesce({x}, ''), '（）', '()')), '[()，,。.:：;；、|\\s_\\-]+', '', 'g')"
_LINES = f"""
  l as (
    select doc_id * 1000000 + i as line_id, doc_id as report_id, cast(i // 40 as integer) as page, i % 40 as line_no, s[i + 1] as text
    from (select doc_id, s, unnest(range(0, len(s))) as i from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))
  ), t as (select *, {_BARE('text')} as b from l),
  f as (
    select line_id as fact_id, report_id, page, w, case line_id % 3 when 0 then array_to_string(w[2:3], ' - ') when 1 then text || ' （zz）' else 'nowhere at all' end as quote
    from (select *, string_split(text, ' ') as w from l) where line_id % 7 = 0 and len(w) >= 4
  ), a as (select fact_id, report_id, page, {_BARE('quote')} as q, {_BARE('w[1]')} as name, {_BARE('w[3]')} as value, {_BARE('w[2]')} as kind, {_BARE('w[4]')} as organ, {_BARE("array_to_string(w[1:3], ',')")} as raw from f)"""
_MEETS = lambda x: f"(contains(b, {x}) or contains({x}, b))"
_ONCE = "row_number() over (partition by fact_id, page, text order by score desc, line_no, line_id) = 1"
_TOP = "row_number() over (partition by fact_id order by score desc, line_no, line_id) <= 5"

SQL = {
    "results_in_lines_of_documents": f"""
        with {_LINES}, s as (
          select fact_id, line_id, page, line_no, text, case when length(q) >= 4 and {_MEETS('q')} then 2 when length(name) >= 2 and value <> '' and contains(b, name) and contains(b, value) then 1 end as score
          from a join t using (report_id, page) where b <> ''
        ) select fact_id, line_id, score from s where score is not null qualify {_ONCE}
    """,
    "findings_in_lines_of_documents": f"""
        with {_LINES}, s as (
          select fact_id, line_id, page, line_no, text, length(q) >= 4 and {_MEETS('q')} as direct,
            {' + '.join(f"case when length({x}) >= 2 and {_MEETS(x)} then least(1, length({x}) / 8) else 0 end" for x in ('raw', 'name', 'kind', 'organ', 'q'))} as sum
          from a join t using (report_id, page) where b <> ''
        ), k as (select *, case when direct then 4.0 else sum end as score from s where direct or sum >= 1.25 qualify {_TOP})
        select fact_id, line_id, cast(score as double) as score from k qualify {_ONCE}
    """,
    "facts_in_lines_of_documents": f"""
        with {_LINES}, s as (
          select fact_id, line_id, page, line_no, text, greatest({', '.join(f"case when length({x}) >= 2 and {_MEETS(x)} then least(length({x}), length(b)) / greatest(length({x}), length(b)) else 0 end" for x in ('name', 'raw', 'q'))}) as score
          from a join t using (report_id, page) where b <> ''
        ), k as (select * from s where score >= 0.35 qualify {_TOP})
        select fact_id, line_id, score from k qualify {_ONCE}
    """,
    "lines_of_documents_explained": f"""
        with {_LINES}, n as (select *, regexp_extract_all(translate(text, '０１２３４５６７８９．', '0123456789.'), '[0-9.]+') as tokens from t where b <> ''),
        p as (
          select line_id,
            bool_or(length(q) >= 4 and {_MEETS('q')} or fact_id % 2 = 0 and length(name || value) >= 4 and {_MEETS('(name || value)')} or fact_id % 2 = 1 and length(raw) >= 4 and {_MEETS('raw')}) as by_text,
            bool_or(fact_id % 2 = 0 and length(name) >= 2 and contains(b, name) and (value <> '' and contains(b, value) or fact_id % 4 = 0 and list_contains(tokens, cast(fact_id % 9 as varchar)))) as by_result,
            bool_or(fact_id % 2 = 1 and (fact_id % 5 <> 0 or list_contains(tokens, cast(fact_id % 10 as varchar)) or list_contains(tokens, '2.5')) and (
              {' + '.join(f"cast(length({x}) >= 2 and {_MEETS(x)} as integer)" for x in ('name', 'kind', 'organ', 'value'))} >= 2
              or {' or '.join(f"length({x}) >= 4 and contains(b, {x})" for x in ('name', 'kind', 'organ', 'value'))})) as by_finding
          from n join a using (report_id) group by 1
        ) select * from p where by_text or by_result or by_finding
    """,
}


def _packed(pages: str, doc: str, limit_pages: int, rows: int | None) -> str:
    """Next-fit page by page; ``pages`` selects ``d, place, ch, c, m``."""
    fits = f"k < {limit_pages} and ch + x.ch + 2 * k <= 8000 and 768 + 96 * (k + 1) + 100 * (c + x.c) + 180 * (m + x.m) + least(768, (ch + x.ch + 2 * k + 7) // 8) <= 12000"
    fits += f" and c + x.c <= {rows}" if rows else ""
    fits = fits.replace("ch + x.ch", "p.ch + x.ch").replace("(c + x.c", "(p.c + x.c").replace("and c + x.c", "and p.c + x.c").replace("(m + x.m", "(p.m + x.m")
    add = lambda n: f"case when {fits} then p.{n} + x.{n} else x.{n} end"
    return f"""
        with recursive {pages},
        p(d, place, unit, k, ch, c, m) as (
          select d, place, 1, 1, ch, c, m from x where place = 0
          union all
          select x.d, x.place, case when {fits} then unit else unit + 1 end, case when {fits} then k + 1 else 1 end, {add('ch')}, {add('c')}, {add('m')}
          from p join x on x.d = p.d and x.place = p.place + 1
        )
        select x.d as {doc}, cast(unit as bigint) as unit, cast(min(x.place) as bigint) as first, count(*) as n_pages, cast(sum(x.ch) as bigint) as characters, cast(sum(x.c) as bigint) as candidate_rows, cast(sum(x.m) as bigint) as morphology_rows
        from p join x on x.d = p.d and x.place = p.place group by all
    """


_PAGES = """l as (select doc_id as d, i // 40 as place, s[i + 1] as text from (select doc_id, s, unnest(range(0, len(s))) as i from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))),
        x as (select d, place, cast(sum(length(text) + 1) - 1 as bigint) as ch, count(*) filter (regexp_matches(text, '[0-9]')) as c, count(*) filter (contains(text, '|')) as m from l group by 1, 2)"""
SQL |= {
    "units_of_documents": _packed(_PAGES, "report_id", 12, 60),
    "narrative_units_of_documents": _packed(_PAGES, "report_id", 24, None),
    "units_of_sources": _packed(
        "x as (select coalesce(source, '') as d, row_number() over (partition by coalesce(source, '') order by doc_id) - 1 as place, length(coalesce(text, '')) as ch, length(coalesce(text, '')) % 40 as c, length(coalesce(text, '')) % 7 as m from documents)", "source", 12, 60
    ),
    "visual_rows_of_pages": r"""
        with s as (select page_id, string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)) as s from pages),
        l as (select page_id, unnest(range(0, len(s))) as j, s from s),
        w as (select page_id, j, string_split_regex(trim(s[j + 1], ' '), ' +') as w from l where trim(s[j + 1], ' ') <> ''),
        c as (select page_id, j, w, unnest(range(0, (len(w) + 3) // 4)) as k from w),
        b as (select page_id, j, k, k % 5 = 4 as low, array_to_string(w[4 * k + 1 : 4 * k + 4], ' ') as text, j * 20 + k % 3 + case when k % 5 = 4 then 10 else 0 end as top from c)
        select page_id, cast(row_number() over (partition by page_id order by j, low) - 1 as integer) as row_no, string_agg(text, ' | ' order by k) as text, round(avg(0.5 + k % 5 / 10), 6) as confidence,
          cast(min(k) * 100 as double) as left, cast(min(top) as double) as top, cast(max(k) * 100 + 90 as double) as right, cast(max(top) + 16 as double) as bottom, cast(count(*) as integer) as n_cells
        from b group by page_id, j, low
    """,
    "wrapped_lines_of_documents": r"""
        with recursive l as (select doc_id, i // 40 as page, i % 40 as line_no, s[i + 1] as text from (select doc_id, s, unnest(range(0, len(s))) as i from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))),
        w(doc_id, page, line_no, start, k, acc) as (
          select doc_id, page, line_no, line_no, 1, text from l where line_no = 0
          union all
          select l.doc_id, l.page, l.line_no, case when g then w.start else l.line_no end, case when g then w.k + 1 else 1 end, case when g then w.acc || l.text else l.text end
          from w join l on l.doc_id = w.doc_id and l.page = w.page and l.line_no = w.line_no + 1,
            lateral (select length(w.acc) >= 24 and not regexp_matches(w.acc, '[。！？；;:：.!?]$') and not regexp_matches(w.acc, '[|｜]') and not regexp_matches(l.text, '[|｜]') and not regexp_matches(l.text, '^\s*(?:[-•*]|\d{1,2}[.、)])') as g)
        )
        select doc_id as report_id, cast(page as integer) as page_number, start as line_no, md5(arg_max(acc, k)) as text_md5, cast(max(k) as integer) as n_lines from w group by 1, 2, 3
    """,
    "budgets_of_documents": """
        with recursive l as (select doc_id, doc_id * 1000000 + i as line_no, length(s[i + 1]) as n from (select doc_id, s, unnest(range(0, len(s))) as i from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))),
        o as (select *, row_number() over (partition by doc_id order by n % 5, line_no) as r from l),
        w(doc_id, r, line_no, n, taken, spent) as (
          select doc_id, r, line_no, n, n <= 2000, case when n <= 2000 then n else 0 end from o where r = 1
          union all
          select o.doc_id, o.r, o.line_no, o.n, spent + o.n <= 2000, case when spent + o.n <= 2000 then spent + o.n else spent end from w join o on o.doc_id = w.doc_id and o.r = w.r + 1
        )
        select doc_id as report_id, line_no, cast(n as integer) as size from w where taken
    """,
    "omission_units_of_documents": """
        with recursive l as (
          select doc_id as d, i // 40 as page, i % 40 as line_no, length(s[i + 1]) as n from (select doc_id, s, unnest(range(0, len(s))) as i from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)) where (doc_id * 1000000 + i) % 3 = 1
        ), k as (select *, n % 4 = 0 as morph, row_number() over (partition by d, n % 4 = 0, page order by line_no) - 1 as r from l),
        b as (select d, morph, page, r // case when morph then 16 else 30 end as chunk, cast(sum(n + 1) - 1 as bigint) as ch, count(*) as c from k group by all),
        x as (select *, row_number() over (partition by d, morph order by page, chunk) - 1 as place, case when morph then c else 0 end as m from b),
        p(d, morph, place, unit, k, page, g, ch, c, m) as (
          select d, morph, place, 1, 1, page, 1, ch, c, m from x where place = 0
          union all
          select x.d, x.morph, x.place, case when fits then p.unit else p.unit + 1 end, case when fits then p.k + 1 else 1 end, x.page, case when fits then p.g + cast(x.page <> p.page as integer) else 1 end,
            case when fits then p.ch + x.ch else x.ch end, case when fits then p.c + x.c else x.c end, case when fits then p.m + x.m else x.m end
          from p join x on x.d = p.d and x.morph = p.morph and x.place = p.place + 1,
            lateral (select p.g + cast(x.page <> p.page as integer) <= 24 and p.ch + x.ch + 2 * p.k <= 8000 and p.c + x.c <= 60
              and 768 + 96 * (p.g + cast(x.page <> p.page as integer)) + 100 * (p.c + x.c) + 180 * (p.m + x.m) + least(768, (p.ch + x.ch + 2 * p.k + 7) // 8) <= 12000 as fits)
        )
        select x.d as report_id, case when x.morph then 'morphology' else 'scalar' end as mode, cast(unit as bigint) as unit, cast(min(x.place) as bigint) as first, count(distinct x.page) as n_pages, cast(sum(x.ch) as bigint) as characters,
          cast(sum(x.c) as bigint) as candidate_rows, cast(sum(x.m) as bigint) as morphology_rows
        from p join x on x.d = p.d and x.morph = p.morph and x.place = p.place group by x.d, x.morph, unit
    """,
    "findings_within_tolerance": """
        with recursive e as (
          select user_id % 500 as report_id, event_type as organ, event_id as position, case when event_id % 4 > 0 then 'region ' || event_id % 2 end as region,
            case when event_id % 3 > 0 then case when event_id % 5 > 0 then [v + 3, v] else [v] end end as sizes, 'text ' || props as raw
          from (select *, cast(floor(abs(value) * 10) as bigint) % 60 / 10 as v from events)
        ), o as (
          select *, row_number() over (partition by report_id, organ order by position) as n, coalesce(len(sizes), 0) + cast(region is not null as integer) + cast(coalesce(raw, '') <> '' as integer) as says from e
        ), w(report_id, organ, n, kept) as (
          select report_id, organ, n, [{'position': position, 'region': region, 'sizes': sizes, 'raw': raw}] from o where n = 1
          union all
          select o.report_id, o.organ, o.n, case when at_k is null then list_append(kept, {'position': o.position, 'region': o.region, 'sizes': o.sizes, 'raw': o.raw})
            else list_concat(list_concat(kept[: at_k - 1], [case when o.says > coalesce(len(kept[at_k].sizes), 0) + cast(kept[at_k].region is not null as integer) + cast(coalesce(kept[at_k].raw, '') <> '' as integer)
              then {'position': kept[at_k].position, 'region': coalesce(o.region, kept[at_k].region), 'sizes': case when coalesce(len(o.sizes), 0) > 0 then o.sizes else kept[at_k].sizes end,
                    'raw': case when length(kept[at_k].raw) > length(coalesce(o.raw, '')) then kept[at_k].raw else o.raw end}
              else {'position': kept[at_k].position, 'region': coalesce(kept[at_k].region, o.region), 'sizes': case when coalesce(len(kept[at_k].sizes), 0) > 0 then kept[at_k].sizes else o.sizes end,
                    'raw': case when length(o.raw) > length(coalesce(kept[at_k].raw, '')) then o.raw else kept[at_k].raw end} end]), kept[at_k + 1 :]) end
          from w join o on o.report_id = w.report_id and o.organ = w.organ and o.n = w.n + 1,
            lateral (select list_position(list_transform(w.kept, lambda k: (k.region is null or o.region is null or k.region = o.region) and (coalesce(len(k.sizes), 0) = 0 or coalesce(len(o.sizes), 0) = 0
              or len(k.sizes) = len(o.sizes) and abs(k.sizes[1] - o.sizes[1]) <= 0.5 and (len(k.sizes) = 1 or abs(k.sizes[2] - o.sizes[2]) <= 0.5))), true) as at_0), lateral (select nullif(at_0, 0) as at_k)
        ), last as (select report_id, organ, unnest(arg_max(kept, n)) as k from w group by 1, 2)
        select report_id, organ, k.position as position, k.region as region, coalesce(array_to_string(list_transform(k.sizes, lambda v: cast(cast(v as decimal(10, 1)) as varchar)), ','), '') as sizes, k.raw as raw_text from last
    """,
    "results_by_source_line": """
        with recursive o as (
          select *, row_number() over (partition by report_id, name order by position) as n from (
            select user_id % 100 as report_id, event_type as name, event_id as position,
              list_filter([case when event_id % 5 > 0 then 'line ' || event_id // 300 end, case when event_id % 7 > 2 then 'quote ' || cast(abs(floor(value)) as bigint) % 40 end], lambda x: x is not null) as ks,
              case when event_id % 3 = 0 then 'u' || event_id % 9 end as unit
            from events)
        ), w(report_id, name, n, kept, known) as (
          select report_id, name, n, [{'position': position, 'ks': ks, 'unit': unit}], list_transform(ks, lambda k: {'k': k, 'i': 1}) from o where n = 1
          union all
          select o.report_id, o.name, o.n,
            case when at_ is null then list_append(w.kept, {'position': o.position, 'ks': o.ks, 'unit': o.unit})
              else list_concat(list_concat(w.kept[: at_ - 1], [{'position': w.kept[at_].position, 'ks': list_concat(w.kept[at_].ks, list_filter(o.ks, lambda k: not list_contains(w.kept[at_].ks, k))), 'unit': coalesce(w.kept[at_].unit, o.unit)}]), w.kept[at_ + 1 :]) end,
            list_concat(w.known, list_transform(o.ks, lambda k: {'k': k, 'i': cast(coalesce(at_, len(w.kept) + 1) as integer)}))
          from w join o on o.report_id = w.report_id and o.name = w.name and o.n = w.n + 1,
            lateral (select list_filter(list_transform(o.ks, lambda k: list_filter(w.known, lambda x: x.k = k)[-1].i), lambda i: i is not null)[1] as at_)
        ), last as (select report_id, name, unnest(arg_max(kept, n)) as k from w group by 1, 2)
        select report_id, name, k.position as position, array_to_string(k.ks, ',') as keys, k.unit as unit from last
    """,
}
