"""Queries over documents, conversations, pages and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.rules import finish_classification, scores_by_kind
from quernstone.functions.text import REDACTIONS, redact
from quernstone.operators.documents import drop_repeated_lines, line_frequency, pack, quality_ladder, text_lines
from quernstone.operators.duplicates import exact_groups, line_set_pairs
from quernstone.sources.tables import spread

from .tables import table

#: Lines of a page where whole texts are cut into pages.
PAGE = 40


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), "doc_id", [F.coalesce("text", F.lit(""))])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share most of their lines, however common: pairs of the smallest ids with their line sets."""
    return near_duplicates_by_all_lines(spark, sf_dir).filter("not same").drop("same")


def near_duplicates_by_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share most of their lines, however common: pairs of representatives, and the documents with their line sets."""
    members, pairs = line_set_pairs(_lines(spark, sf_dir).select("doc_id", "line"), "doc_id", "line")
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    out = pairs.select("a", "b", F.lit(False).alias("same"), "shared", F.round(F.col("shared") / low, 4).alias("of_min"), F.round(F.col("shared") / high, 4).alias("of_max"))
    return out.unionByName(members.select("a", "b", F.lit(True).alias("same"), F.col("n").alias("shared"), F.lit(1.0).alias("of_min"), F.lit(1.0).alias("of_max")))


def line_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = line_frequency(_lines(spark, sf_dir), "doc_id").filter("n_docs >= 2")
    return freq.select("n_docs", F.sha2("key", 256).alias("line"))


def repeated_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages: lines that many turns begin or end with are left out."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    kept = drop_repeated_lines(lines, "conv_id", "turn", "line_no")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def repeated_line_removal_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents, each text cut into pages of ``PAGE`` lines."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    each = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).filter("trim(line) <> ''")
    lines = each.select("doc_id", F.floor(F.col("at") / PAGE).alias("page"), (F.col("at") % PAGE).alias("line_no"), "line")
    kept = drop_repeated_lines(lines, "doc_id", "page", "line_no")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), redact(F.coalesce("text", F.lit(""))).alias("clean"))
    return docs.filter("clean <> text").select("doc_id", F.length("clean").alias("n_chars"), F.sha2("clean", 256).alias("clean_sha256"))


def identifier_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    parts = table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).alias("page"), F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
    )
    return parts.select("page_id", "host", "page", "lang", F.sha2("title", 256).alias("title_sha256"))


# Weighted signals of the kinds of synthetic documents.
SIGNALS = {
    "table": ((r" \| .* \| ", 8), (r"\|\s*$", 3)),
    "license": ((r"Licensed under|License", 7), (r"Version [0-9.]+", 3)),
    "shouting": ((r"[A-Z]{4,}!! [A-Z]+!!", 9),),
    "symbols": ((r"(###|\$\$\$|%%%|&&&|\*\*\*)", 6), (r"[#$%&*]{3}\s.*[#$%&*]{3}\s", 4)),
    "contact": ((r"[a-z0-9._-]+@[a-z0-9.-]+", 6), (r"https?://", 4)),
}


def content_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = finish_classification(scores_by_kind(F.coalesce("text", F.lit("")), SIGNALS))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", done.alias("c"))
    return rows.select("doc_id", F.array_join("c.kinds", ",").alias("kinds"), F.col("c.confidence").alias("confidence"))


def quality_score_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.length(t).alias("chars"), F.length(F.regexp_replace(t, "[^0-9]", "")).alias("digits"),
        F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")).alias("useful"),
    )
    share = F.when(F.col("chars") > 0, F.col("useful") / F.col("chars")).otherwise(0.0)
    q = quality_ladder(F.col("lines"), F.col("chars"), F.col("digits"), share, F.lit(0.8))
    return rows.select("doc_id", q["score"].alias("score"), q["level"].alias("level"))


def dictionary_match_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entry of a small dictionary for each part's name: by scope, type and size."""
    aliases = spark.createDataFrame(
        [("ring", "ring", "STANDARD", 0), ("bolt", "bolt", "SMALL", 0), ("bolt", "bolt_promo", "PROMO", 5), ("gear", "gear", "ECONOMY", 0), ("widget", "widget", "MEDIUM", 0), ("red", "red_part", "LARGE", 10), ("small", "small_part", "SMALL", 0)],
        "alias string, key string, kind string, bonus int",
    )
    words = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.explode(F.array_distinct(F.split("p_name", " "))).alias("alias"))
    met = words.join(F.broadcast(aliases), "alias")  # seven rows
    score = F.lit(55) + F.col("bonus") + F.when(F.col("p_type") == F.col("kind"), 25).otherwise(-15) + F.when(F.col("p_size") < 20, 15).otherwise(0)
    best = met.withColumn("score", score).groupBy("p_partkey").agg(F.min_by(F.struct("key", "score"), F.struct(-F.col("score"), F.col("key"))).alias("b"))
    return best.select("p_partkey", "b.key", "b.score")


def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return pack(turns, ["conv_id"], ["turn"], F.length(F.coalesce("text", F.lit(""))), 1500, 3)


def packing_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, in the order of their ids, in units of 60,000 characters and 40 documents at most."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    out = pack(docs, ["source"], ["doc_id"], F.length(F.coalesce("text", F.lit(""))), 60_000, 40)
    return out.select(F.coalesce("source", F.lit("")).alias("source"), "unit", "items", "total", "first")


def html_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    for pattern, mark in ((r"<(script|style)[^>]*>[^<]*</(script|style)>", ""), (r"<!--[^-]*-->", ""), (r"<(p|br|li|h1|div|/p|/li|/h1|/div)[^>]*>", "\n"), (r"<[^>]*>", "")):
        html = F.regexp_replace(html, pattern, mark)
    lines = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.explode(F.split(html, "\n")).alias("line")).filter("trim(line) <> ''")
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_duplicates, near_duplicates, near_duplicates_by_all_lines, line_document_frequency, repeated_line_removal, repeated_line_removal_in_documents, pii_redaction, identifier_extraction, content_classifier,
        quality_score_ladder, dictionary_match_argmax, greedy_packing, packing_of_documents, html_text_lines,
    )
}


def _redacted(text: str) -> str:
    for pattern, mark in REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


def _score(rules: tuple) -> str:
    return " + ".join("case when regexp_matches(t, '{}') then {}.0 else 0.0 end".format(p.replace("'", "''"), w) for p, w in rules)


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "
_KEY = f"regexp_replace(regexp_replace(lower(translate(line, '{_WIDE}', '{_NARROW}')), '[0-9]+', '#', 'g'), '\\s+', '', 'g')"
_LINES = "l as (select doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) as line from documents)"

SQL = {
    "exact_duplicates": "select sha256(coalesce(text, '')) as content, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) >= 2",
    "near_duplicates": f"""
        with {_LINES}, p as (select distinct doc_id, sha256(line) as k from l where line <> ''),
        s as (select doc_id, count(*) as n, list_sort(list(k)) as ks from p group by 1), r as (select *, min(doc_id) over (partition by ks) as rep from s),
        i as (select doc_id, k from p join r using (doc_id) where doc_id = rep),
        j as (select x.doc_id as a, y.doc_id as b, count(*) as shared from i x join i y on x.k = y.k and x.doc_id < y.doc_id group by 1, 2)
        select a, b, shared, round(shared / least(s.n, t.n), 4) as of_min, round(shared / greatest(s.n, t.n), 4) as of_max
        from j join s on s.doc_id = a join s t on t.doc_id = b where shared >= 3 and shared / least(s.n, t.n) >= 0.6
    """,
    "near_duplicates_by_all_lines": f"""
        with {_LINES}, p as (select distinct doc_id, sha256(line) as k from l where line <> ''),
        s as (select doc_id, count(*) as n, list_sort(list(k)) as ks from p group by 1),
        r as (select *, min(doc_id) over (partition by ks) as rep from s),
        i as (select doc_id, k from p join r using (doc_id) where doc_id = rep),
        j as (select x.doc_id as a, y.doc_id as b, count(*) as shared from i x join i y on x.k = y.k and x.doc_id < y.doc_id group by 1, 2)
        select a, b, false as same, shared, round(shared / least(s.n, t.n), 4) as of_min, round(shared / greatest(s.n, t.n), 4) as of_max
        from j join s on s.doc_id = a join s t on t.doc_id = b where shared >= 3 and shared / least(s.n, t.n) >= 0.6
        union all select rep, doc_id, true, n, 1.0, 1.0 from r where doc_id <> rep
    """,
    "line_document_frequency": f"""
        with {_LINES}, k as (select distinct doc_id, {_KEY} as key from l where line <> '')
        select count(*) as n_docs, sha256(key) as line from k group by key having count(*) >= 2
    """,
    "repeated_line_removal": f"""
        with s as (select conv_id, turn, string_split(coalesce(text, ''), chr(10)) as parts from conversations),
        l as (select conv_id, turn, unnest(parts) as line, unnest(range(len(parts))) as line_no from s),
        f as (select *, {_KEY} as fp from l where trim(line) <> ''),
        e as (select *, line_no < 4 or line_no > max(line_no) over (partition by conv_id, turn) - 4 as edge from f),
        t as (select conv_id, count(distinct turn) as pages from f group by 1),
        o as (select conv_id, fp, count(distinct turn) as n, min((turn, line_no)) as first from e where edge group by 1, 2),
        r as (select conv_id, fp, first from o join t using (conv_id) where n >= greatest(3, ceil(pages * 0.2)))
        select conv_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars
        from e left join r using (conv_id, fp) where not (first is not null and edge and (turn, line_no) <> first) group by 1
    """,
    "repeated_line_removal_in_documents": f"""
        with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
        u as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from s),
        l as (select doc_id, pos // {PAGE} as page, pos % {PAGE} as line_no, line from u),
        f as (select *, {_KEY} as fp from l where trim(line) <> ''),
        e as (select *, line_no < 4 or line_no > max(line_no) over (partition by doc_id, page) - 4 as edge from f),
        t as (select doc_id, count(distinct page) as pages from f group by 1),
        o as (select doc_id, fp, count(distinct page) as n, min((page, line_no)) as first from e where edge group by 1, 2),
        r as (select doc_id, fp, first from o join t using (doc_id) where n >= greatest(3, ceil(pages * 0.2)))
        select doc_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars
        from e left join r using (doc_id, fp) where not (first is not null and edge and (page, line_no) <> first) group by 1
    """,
    "pii_redaction": f"""
        with d as (select doc_id, coalesce(text, '') as text from documents), c as (select doc_id, text, {_redacted("text")} as clean from d)
        select doc_id, length(clean) as n_chars, sha256(clean) as clean_sha256 from c where clean <> text
    """,
    "identifier_extraction": r"""
        select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(url, '[?&]page=([0-9]+)', 1) as page,
          regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, sha256(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title_sha256
        from pages
    """,
    "content_classifier": "with s as (select doc_id, coalesce(text, '') as t from documents), k as ("
    + " union all ".join(f"select doc_id, {i} as ord, '{k}' as kind, {_score(r)} as score from s" for i, (k, r) in enumerate(SIGNALS.items()))
    + """), r as (select *, row_number() over (partition by doc_id order by score desc, ord) as rn from k where score > 0),
        w as (select doc_id, max(case when rn = 1 then kind end) as k1, max(case when rn = 1 then score end) as s1,
                max(case when rn = 2 then kind end) as k2, coalesce(max(case when rn = 2 then score end), 0) as s2 from r group by 1)
        select doc_id, case when k1 is null then 'other' when s2 >= greatest(6, s1 * 0.55) then k1 || ',' || k2 else k1 end as kinds,
          case when k1 is null then 0.0 else round(cast(greatest(0.25, least(1, s1 / greatest(1, s1 + s2 * 0.65))) as double), 3) end as confidence
        from documents left join w using (doc_id)
    """,
    "quality_score_ladder": """
        with t as (select doc_id, coalesce(text, '') as t from documents), m as (select doc_id, length(t) - length(replace(t, chr(10), '')) + 1 as lines, length(t) as chars,
          length(regexp_replace(t, '[^0-9]', '', 'g')) as digits, length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) as useful from t),
        s as (select doc_id, chars, case when lines >= 20 then 20 when lines >= 8 then 14 when lines >= 3 then 8 else 0 end
          + case when chars >= 600 then 25 when chars >= 200 then 18 when chars >= 60 then 10 else 0 end
          + case when digits >= 20 then 15 when digits >= 5 then 8 else 0 end
          + case when chars > 0 and useful / chars >= 0.75 then 20 when chars > 0 and useful / chars >= 0.5 then 12 else 0 end + 12 as score from m)
        select doc_id, score, case when score >= 70 then 'good' when score >= 45 then 'fair' when chars > 0 then 'poor' else 'empty' end as level from s
    """,
    "dictionary_match_argmax": """
        with a(alias, key, kind, bonus) as (values ('ring', 'ring', 'STANDARD', 0), ('bolt', 'bolt', 'SMALL', 0), ('bolt', 'bolt_promo', 'PROMO', 5), ('gear', 'gear', 'ECONOMY', 0),
          ('widget', 'widget', 'MEDIUM', 0), ('red', 'red_part', 'LARGE', 10), ('small', 'small_part', 'SMALL', 0)),
        w as (select distinct p_partkey, p_type, p_size, unnest(string_split(p_name, ' ')) as alias from part),
        s as (select p_partkey, key, 55 + bonus + case when p_type = kind then 25 else -15 end + case when p_size < 20 then 15 else 0 end as score from w join a using (alias))
        select p_partkey, key, score from s qualify row_number() over (partition by p_partkey order by score desc, key) = 1
    """,
    "packing_of_documents": """
        with recursive t as (select coalesce(source, '') as s, length(coalesce(text, '')) as n, row_number() over (partition by source order by doc_id) - 1 as ord from documents),
        p(s, ord, unit, items, total, n) as (
          select s, ord, 1, 1, n, n from t where ord = 0
          union all
          select t.s, t.ord, case when items < 40 and total + t.n <= 60000 then unit else unit + 1 end, case when items < 40 and total + t.n <= 60000 then items + 1 else 1 end, case when items < 40 and total + t.n <= 60000 then total + t.n else t.n end, t.n
          from p join t on t.s = p.s and t.ord = p.ord + 1)
        select s as source, unit, count(*) as items, cast(sum(n) as bigint) as total, cast(min(ord) as integer) as first from p group by 1, 2
    """,
    "greedy_packing": """
        with recursive t as (select conv_id, length(coalesce(text, '')) as n, row_number() over (partition by conv_id order by turn) - 1 as ord from conversations),
        p(conv_id, ord, unit, items, total, n) as (
          select conv_id, ord, 1, 1, n, n from t where ord = 0
          union all
          select t.conv_id, t.ord, case when items < 3 and total + t.n <= 1500 then unit else unit + 1 end,
            case when items < 3 and total + t.n <= 1500 then items + 1 else 1 end, case when items < 3 and total + t.n <= 1500 then total + t.n else t.n end, t.n
          from p join t on t.conv_id = p.conv_id and t.ord = p.ord + 1)
        select conv_id, unit, count(*) as items, cast(sum(n) as bigint) as total, cast(min(ord) as integer) as first from p group by 1, 2
    """,
    "html_text_lines": r"""
        with c as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<(script|style)[^>]*>[^<]*</(script|style)>', '', 'g'),
          '<!--[^-]*-->', '', 'g'), '<(p|br|li|h1|div|/p|/li|/h1|/div)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from pages),
        l as (select page_id, unnest(string_split(t, chr(10))) as line from c)
        select page_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from l where trim(line) <> '' group by 1
    """,
}
