"""Queries over lines of reports: keys, numbers, units, dates, roles.

The lines are derived from ``events``: each event is a line of a report, one of a few phrases with the event's value in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import dates as D
from quernstone.functions import line_rules as L
from quernstone.functions import numeric as N
from quernstone.functions import text as T
from quernstone.functions import units as U
from quernstone.functions.report_rules import IDENTIFIER_LABELS
from quernstone.functions.text import _NARROW, _WIDE
from quernstone.operators import screening as S
from quernstone.operators.dictionary import compact_alias
from quernstone.operators.documents import is_noise
from quernstone.operators.reports import similar_title
from quernstone.operators.views import abbreviated, log_kind
from quernstone.sources.tables import spread

from .tables import table

# What lines say; {q} is a number of the line's event, {r} a larger one.
PHRASES = (
    "白细胞计数(WBC) | {q}.5 | 10^9/L | 3.5-9.5", "血红蛋白 HGB {r} g/L ↑", "总胆固醇：{q}.25 mmol/L 参考值 <5.2", "项目名称 结果 单位 参考范围", "【超声检查】", "肝脏: 囊肿 {q}×8×5mm 边界清晰",
    "左侧甲状腺结节 1.2cm×{q}mm", "未见明显结节", "第 {q} 页 共 12 页", "本报告仅供临床参考", "检查日期：2023年{q}月5日 10:30", "报告日期 2024-03-1{d}", "血糖", "尿蛋白 阴性", "结果：弱阳性",
    "备注|Note A-{q}|", "ＡＬＴ　（谷丙转氨酶）　{q}　U／L", "C-TIRADS {d} 类", "打印时间: 2024/01/0{d}", "历史检查结果（2）", "健康教育", "acme {q}", "姓名：某某", "***", "建议 {d} 个月后复查", "  脾脏 大小正常 ", "> 100", "≤ {q}.5 次/min",
    "CRP+ {q},{r} mg/L", "电话: 13812345678", "{q} - {r}", "血压 1{q}/8{d} mmHg", "a/b\\c:{q}.txt", "WBC: {q}", "增益：10mm/mV",
)
# Full-width forms that the phrases hold are narrowed by the same table as in the operators.
SPACE = r"[\s\p{P}\p{S}]+"


def said(id_: Column, member: Column, value: Column) -> Column:
    """The phrase of a line."""
    text = F.get(F.array(*[F.lit(p) for p in PHRASES]), ((id_ * 7 + member) % len(PHRASES)).cast("int"))
    n = F.abs(F.floor(value)).cast("long")
    for mark, number in (("{q}", n % 9 + 1), ("{r}", n % 190 + 30), ("{d}", n % 7 + 1)):
        text = F.replace(text, F.lit(mark), number.cast("string"))
    return text


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, member_id, report_id, page_number, line_no, text, value, ts, event_type``."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return spread(e.select(
        i.alias("line_id"), F.col("user_id").alias("member_id"), F.floor(i / 16).alias("report_id"), (F.floor(i / 4) % 4 + 1).cast("int").alias("page_number"), (i % 4).cast("int").alias("line_no"),
        said(i, F.col("user_id"), F.col("value")).alias("text"), "value", "ts", "event_type",
    ))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_N = "cast(abs(floor(value)) as bigint)"
LINES = f"""lines as (select event_id as line_id, user_id as member_id, event_id // 16 as report_id, cast((event_id // 4) % 4 + 1 as integer) as page_number, cast(event_id % 4 as integer) as line_no,
  replace(replace(replace([{", ".join(map(_q, PHRASES))}][(event_id * 7 + user_id) % {len(PHRASES)} + 1],
    '{{q}}', cast({_N} % 9 + 1 as varchar)), '{{r}}', cast({_N} % 190 + 30 as varchar)), '{{d}}', cast({_N} % 7 + 1 as varchar)) as text, value, ts, event_type from events)"""


def narrowed(x: str) -> str:
    return f"translate({x}, {_q(_WIDE)}, {_q(_NARROW)})"


def _gone(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(by)}, 'g')"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern.replace(L.EDGE, chr(92) + 'b'))})"


def _no_plus(x: str) -> str:
    return f"replace({_gone(f'replace({x}, chr(43), chr(1))', SPACE)}, chr(1), chr(43))"


def _cut(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {_q(pattern)}, {group})"


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a line for the ways in which lines are compared."""
    t = F.col("text")
    return lines(spark, sf_dir).select(
        "line_id", T.indicator_key(t).alias("indicator"), T.qualified_key(t).alias("qualified"), T.content_key(t).alias("content"), T.line_key(t).alias("letters"), T.line_fingerprint(t).alias("fingerprint"),
        F.array_join(T.table_cells(t), "~").alias("cells"), F.coalesce(T.trimmed(t, 6), F.lit("")).alias("short"), T.file_name(t).alias("file"), abbreviated(t).alias("abbreviated"), compact_alias(t).alias("alias"),
        S.label_of(t).alias("label"), F.coalesce(S.feedback_name(t), F.lit("-")).alias("feedback"),
    )


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names under which a line's name may be listed."""
    return lines(spark, sf_dir).select("line_id", F.array_join(T.name_variants(F.col("text")), "~").alias("names"))


def similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a line compares with the one before it: as text, as an institution, by its title."""
    x = lines(spark, sf_dir)
    before = x.select((F.col("line_id") + len(PHRASES)).alias("line_id"), F.col("text").alias("was"))
    a, b = F.col("text"), F.col("was")
    return x.join(before, "line_id").select("line_id", T.similar_text(a, b, 6, 5).alias("alike"), T.same_institution(a, b).alias("institution"), similar_title(a, b).alias("title"))


def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of a line, its range, its flag, and the flag after the range was looked at."""
    t, none = F.col("text"), F.lit(-1.0)
    r = N.reference_range(t)
    x = lines(spark, sf_dir).select("line_id", N.first_number(t).alias("n"), r["low"].alias("lo"), r["high"].alias("hi"), N.abnormal_flag(t).alias("f"), "value", t.alias("text"))
    fixed = N.corrected_flag(F.col("n"), F.col("lo"), F.col("hi"), F.col("f"))
    return x.select(
        "line_id", F.coalesce("n", none).alias("number"), F.coalesce("lo", none).alias("low"), F.coalesce("hi", none).alias("high"), F.coalesce("f", F.lit("")).alias("flag"), F.coalesce(fixed, F.lit("")).alias("corrected"),
        N.clamp(F.col("value"), 2.0, 50.0).alias("clamped"), N.half_up(F.col("n"), 0).alias("whole"), N.quality_bucket(F.col("n") * 10, F.col("n").isNull()).alias("bucket"),
        N.display_number(F.col("n") / 3).alias("shown"),
    )


def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output tokens that a report's pages will need, and the budget for them."""
    t = F.col("text")
    x = lines(spark, sf_dir).groupBy("report_id").agg(F.count_distinct("page_number").alias("p"), F.count_if(S.is_candidate(t)).alias("c"), F.count_if(S.is_morphology(t)).alias("m"), F.sum(F.length(t)).alias("n"))
    need = N.token_estimate(F.col("p"), F.col("c"), F.col("m"), F.col("n"))
    return x.select("report_id", need.alias("estimate"), N.output_budget(need).alias("budget"))


def sizes_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = N.size_of(F.col("text"))
    x = lines(spark, sf_dir).select("line_id", s.alias("s")).filter("s is not null")
    v = N.size_vector(F.col("s"))
    return x.select(
        "line_id", "s.length", "s.width", F.coalesce("s.height", F.lit(-1.0)).alias("height"), F.coalesce("s.unit", F.lit("")).alias("unit"), F.coalesce(N.largest_mm(F.col("s")), F.lit(-1.0)).alias("largest"),
        F.array_max(v).alias("most"), F.size(v).alias("sides"),
    )


def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    x = lines(spark, sf_dir).select(
        "line_id", D.normal_date(t).alias("found"), D.labelled_date(t, ["报告日期", "检查日期"]).alias("labelled"), D.valid_date_input(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("given"),
        D.valid_date_input(F.substring(t, -10, 10)).alias("tail"), D.date_part(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day"),
    )
    return x.select("line_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("found", "labelled", "given", "tail", "day")])


def units_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a few analytes in canonical and in other units; centimetres and millimetres convert for any of them."""
    spell = F.array(*[F.lit(u) for u in _SPELLINGS])
    unit = F.get(spell, (F.col("line_id") % len(_SPELLINGS)).cast("int"))
    key = F.get(F.array(*[F.lit(k) for k in _ANALYTES]), (F.col("member_id") % len(_ANALYTES)).cast("int"))
    to = F.get(F.array(*[F.lit(u) for u in _TARGETS]), ((F.col("line_id") + F.col("member_id")) % len(_TARGETS)).cast("int"))
    x = lines(spark, sf_dir).select("line_id", key.alias("key"), U.canonical_unit(unit).alias("unit"), to.alias("wanted"), "value")
    k, u, t = F.col("key"), F.col("unit"), F.col("wanted")
    made = U.converted(k, F.col("value"), u, t)
    return x.select("line_id", "key", F.coalesce("unit", F.lit("")).alias("unit"), "wanted", F.coalesce(U.convertible(k, u, t), F.lit(False)).alias("can"), F.round(F.coalesce(made, F.lit(-1.0)), 4).alias("converted"))


# Fixed values of the query: spellings of units, analytes and units asked for.
_SPELLINGS = ("MG / DL", "mmol/l", "cm", "毫米", "μmol／L", "g/dl", "", "10*9/L", "furlong")
_ANALYTES = ("lipid_tc", "renal_creatinine", "cbc_hgb", "glucose_random", "polyp")
_TARGETS = ("mmol/L", "μmol/L", "mm", "cm", "g/L", "mg/dL")


def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a line is for: a boundary, a result, a finding, a remark, noise."""
    t, c = F.col("text"), F.when(F.col("line_id") % 3 == 0, 0.2).otherwise(0.9)
    x = lines(spark, sf_dir).withColumn("c", c)
    return x.select(
        "line_id", F.coalesce(S.boundary(t), F.lit("")).alias("boundary"), S.is_candidate(t).alias("candidate"), S.is_morphology(t).alias("morphology"), S.is_non_result(t).alias("non_result"),
        is_noise(t, F.col("c")).alias("noise"),
    )


def identifiers_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business identifiers behind their labels, of three characters or more."""
    i = F.col("line_id")
    label = F.get(F.array(*[F.lit(x) for x in IDENTIFIER_LABELS]), (i % len(IDENTIFIER_LABELS)).cast("int"))
    said = F.concat(F.col("text"), F.lit("; "), label, F.when(i % 2 == 0, "： ").otherwise(" #"), F.when(i % 3 == 0, "A1").otherwise(F.concat(F.lit("A-"), i)))
    x = lines(spark, sf_dir).select("line_id", said.alias("t"))
    return x.select("line_id", *[F.coalesce(T.labelled_value(F.col("t"), x), F.lit("")).alias(f"id{n}") for n, x in enumerate(IDENTIFIER_LABELS[:3])])


def pages_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of reports that have to be read as images, for their little text or their large pictures."""
    x = lines(spark, sf_dir).groupBy("report_id", "page_number").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("value").alias("v"))
    return x.select("report_id", "page_number", S.needs_ocr(F.col("n") * 4, F.col("chars") * 10, F.col("v") / 1000).alias("read"))


def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What log lines are about, by their messages: events as log lines."""
    words = F.array(*[F.lit(w) for w in _MESSAGES])
    x = lines(spark, sf_dir).withColumn("message", F.get(words, (F.col("line_id") % len(_MESSAGES)).cast("int")))
    return x.groupBy(log_kind(F.col("message")).alias("kind"), "event_type").agg(F.count("*").alias("n"))


_MESSAGES = ("OCR worker started", "AI_extract done", "Upload finished", "backup written", "schema migrated", "dictionary active", "tick")


QUERIES = {
    f.__name__: f
    for f in (
        text_keys, name_keys, similar_lines, numbers_in_text, token_budgets, sizes_in_text, dates_in_text, units_of_values, line_roles, identifiers_in_lines, pages_to_read, log_pages,
    )
}

_BR = T.BRACKETS
_CODE = r"([A-Za-z][A-Za-z0-9%#+-]*)"
_CELLS = "list_transform(regexp_split_to_array({0}, '[|｜]'), lambda x: trim(x))"
_LABEL = _gone(_gone("trim({0})", r"^【\s*|\s*】$"), r"[:：]$")
_PRIVATE = " or ".join(_has("n", p) for p in (r"\b1[3-9]\d{9}\b", r"\b\d{17}[0-9xX]\b", r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"))
_QUALIFIED, _INDICATOR = _no_plus(f"lower({narrowed('text')})"), _no_plus(_gone(f"lower({narrowed('text')})", _BR))
_CONTENT = lambda x: _gone(f"lower({narrowed(f'coalesce({x}, chr(32))')})", SPACE)
_RANGE = _gone("trim(text)", r"[～~—–－至]+|\s+to\s+", "-")
_BOTH = r"(-?\d+(?:\.\d+)?)\s*-+\s*(-?\d+(?:\.\d+)?)"
_UPPER, _LOWER = r"^(?:<|≤|＜|<=|小于|不超过)\s*=?\s*(\d+(?:\.\d+)?)", r"^(?:>|≥|＞|>=|大于|不低于)\s*=?\s*(\d+(?:\.\d+)?)"
_SIZE = r"(\d+(?:\.\d+)?)\s*(?:(mm|cm|毫米|厘米)\s*)?[×xX*＊]\s*(\d+(?:\.\d+)?)(?:\s*(?:mm|cm|毫米|厘米)?\s*[×xX*＊]\s*(\d+(?:\.\d+)?))?\s*(mm|cm|毫米|厘米)?"
_DATE = r"(\d{4})\s*[年./~-]\s*(\d{1,2})\s*[月./~-]\s*(\d{1,2})\s*日?(?:\s*[T ]?\s*(\d{1,2})[:：时](\d{1,2})(?:[:：分](\d{1,2}))?)?"
_OK = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$"
_TAIL = r"\s*[:：]?\s*(\d{4}\s*[年./~-]\s*\d{1,2}\s*[月./~-]\s*\d{1,2}\s*日?(?:\s*\d{1,2}[:：]\d{1,2}(?:[:：]\d{1,2})?)?)"


def _day(x: str) -> str:
    g = lambda i: _cut(x, _DATE, i)
    two = lambda i: f"lpad({g(i)}, 2, '0')"
    return f"""case when {g(1)} = '' then null when {g(4)} = '' then {g(1)} || '-' || {two(2)} || '-' || {two(3)}
      else {g(1)} || '-' || {two(2)} || '-' || {two(3)} || ' ' || {two(4)} || ':' || {two(5)} || ':' || case when {g(6)} = '' then '00' else {two(6)} end end"""


def _double(x: str) -> str:
    return f"try_cast(nullif({x}, '') as double)"


def roles_sql(t: str) -> dict[str, str]:
    """Boundary, candidate and the other roles of a line as SQL expressions, over the same patterns."""
    cells = f"list_filter({_CELLS.format(t)}, lambda x: x <> '')"
    label = _LABEL.format
    left = t
    for p in L.NEGATED:
        left = _gone(left, p)
    graded = _gone(left, r"(?i)(?:C-TIRADS|BI-RADS)\s*\d?")
    left = f"case when {_has(t, L.NEGATED_GRADE_1)} then {graded} else {left} end"
    morphology = f"({_has(t, L.MORPHOLOGY)} and {_has(left, L.MORPHOLOGY)})"
    non_result = f"({_has(f'trim({t})', L.TECHNICAL)} or ({_has(f'trim({t})', L.INTERPRETATION_ONLY)} and not {_has(f'trim({t})', '[|｜]')} and not {_has(f'trim({t})', '(?:检验|检查|报告)?结果\\s*[:：]')}))"
    tt, first, second = f"trim({t})", f"{cells}[1]", f"coalesce({cells}[2], '')"
    unit, digit = _has(tt, L.UNIT), _has(tt, r"\d")
    against = " or ".join((
        non_result, *[_has(tt, p) for p in (L.TABLE_HEADER, L.METADATA_LABEL, L.METADATA_ROW, L.PAGE_MARK, L.REFERENCE_ONLY, L.DIRECTORY_LINE, L.DIRECTORY_ROW, L.NUMBER_ONLY)],
        f"({_has(tt, r'\d{12,}')} and not {unit} and not {_has(tt, '参考值|参考范围|正常范围')})", f"not ({_has(first, r'\p{L}{2,}')} or ({_has(first, r'[\x{3400}-\x{9fff}]')} and {unit}))",
        _has(first, L.QUALITATIVE_NAME), f"(length({tt}) > 240 and not {_has(tt, '[|｜]')})",
    ))
    for_ = " or ".join((
        morphology, f"(len({cells}) >= 2 and {_has(second, L.CANDIDATE_CELL)})", f"({unit} and {digit})", f"({_has(tt, '[↑↓▲▼]')} and {digit})", _has(tt, L.QUALITATIVE_RESULT),
        _has(tt, L.QUALITATIVE_TAIL), f"({_has(tt, '[|｜]')} and {_has(tt, L.QUALITATIVE_COLUMN)} and not {_has(tt, L.REGION_LEGEND)})", f"({_has(tt, '参考值|参考范围|正常范围')} and {digit})", f"(not {_has(tt, r'\b20\d{2}-\d{1,2}')} and {_has(tt, r'\d(?:\.\d+)?\s*[~～-]\s*\d')})",
        _has(tt, r"(?:^|[|｜])[^|｜]{1,24}[:：]\s*[-+]?\d+(?:\.\d+)?"),
    ))
    heads = f"coalesce(list_bool_and(list_transform({cells}, lambda x: {_has(label('x'), L.SECTION_HEADING)} or {label('x')} in ('诊断所见', '诊断结果', '检查描述', '检查提示'))), true)"
    english = f"coalesce(list_bool_and(list_transform({cells}[2:], lambda x: {_has('x', r'^[A-Za-z][A-Za-z\s&/()-]{2,}$')})), true)"
    f1 = label(first)
    single = f"(length({tt}) <= 48 and ({_has(tt, r'^【[^】]{1,40}】$')} or {_has(label(tt), L.SECTION_HEADING)} or {_has(label(tt), L.HISTORICAL_SECTION)} or {_has(label(tt), L.CONTENT_RESTART)} or ({_has(tt, '[:：]$')} and not {digit})))"
    boundary = f"""case when {_has(tt, L.TABLE_HEADER)} then 'table_header' when len({cells}) > 1 and ({heads} or ({english} and ({_has(f1, L.SECTION_HEADING)} or {_has(f1, L.CONTENT_RESTART)}))) then 'section'
      when not len({cells}) > 1 and {single} then 'section' end"""
    return {"boundary": boundary, "candidate": f"coalesce(not ({against}) and ({for_}), false)", "morphology": morphology, "non_result": non_result}


_ROLE = roles_sql("text")
_NOISE = _gone(narrowed("text"), r"\s+")

SQL = {
    "text_keys": f"""
        with {LINES} select line_id, {_INDICATOR} as indicator, {_QUALIFIED} as qualified, {_CONTENT('text')} as content, lower({_gone('text', r'[^\p{L}\p{N}]')}) as letters,
          {_gone(_gone(f"lower({narrowed('text')})", r'\d+', '#'), r'\s+')} as fingerprint, array_to_string({_CELLS.format('text')}, '~') as cells, substring(trim(text), 1, 6) as short,
          substring({_gone('text', r'[\x00-\x1F\x7F/\\]+', '_')}, 1, 180) as file, case when length(text) <= 12 then text else substring(text, 1, 6) || '…' || substring(text, -4, 4) end as abbreviated,
          {_gone(f"lower({narrowed('text')})", r'[（）()：:，,。.;；、|\s_-]')} as alias, trim({_LABEL.format('text')}) as label,
          case when n <> '' and length(n) <= 120 and not ({_PRIVATE}) then n else '-' end as feedback
        from (select *, trim({_gone(_gone(narrowed('text'), r'[\x00-\x1f\x7f]+', ' '), r'\s+', ' ')}) as n from lines)
    """,
    "name_keys": f"""
        with {LINES}, k as (select line_id, [{_QUALIFIED}, {_INDICATOR}, {", ".join(_gone(f"lower({_cut('p', pattern, 1)})", r'[\s-]+') for pattern in (r"[(\[{（【]\s*" + _CODE + r"\s*[)\]}）】]", "^" + _CODE + r"[\s\-:：]+[^A-Za-z].*$", r"^[^A-Za-z]+?[\s\-:：]*" + _CODE + "$"))}] as k
          from (select *, trim({narrowed('text')}) as p from lines)),
        e as (select line_id, i, k[i] as x from k, (select unnest(range(1, 6)) as i)), f as (select line_id, x, min(i) as i from e where x <> '' group by 1, 2)
        select l.line_id, coalesce(string_agg(x, '~' order by i), '') as names from lines l left join f using (line_id) group by 1
    """,
    "similar_lines": f"""
        with {LINES}, p as (select a.line_id, {_CONTENT('a.text')} as x, {_CONTENT('b.text')} as y from lines a join lines b on b.line_id + {len(PHRASES)} = a.line_id)
        select line_id, length(x) >= 6 and length(y) >= 6 and (x = y or contains(x, substring(y, 1, 5)) or contains(y, substring(x, 1, 5))) as alike,
          x <> '' and y <> '' and (x = y or (least(length(x), length(y)) >= 6 and least(length(x), length(y)) / greatest(length(x), length(y)) >= 0.55 and (contains(x, y) or contains(y, x)))) as institution,
          x <> '' and (x = y or (least(length(x), length(y)) >= 8 and (contains(x, y) or contains(y, x)))) as title
        from p
    """,
    "numbers_in_text": f"""
        with {LINES}, n as (select *, {_double(_cut(_gone(_gone('text', ','), '[<>≤≥＜＞]', ' '), N.NUMBER))} as n,
            coalesce({_double(_cut(_RANGE, _BOTH, 1))}, {_double(_cut(_RANGE, _LOWER, 1))}) as lo, coalesce({_double(_cut(_RANGE, _BOTH, 2))}, {_double(_cut(_RANGE, _UPPER, 1))}) as hi,
            case when {_has('text', r'[↑⬆▲]|偏高|升高|(?i:\bhigh\b)|(?:^|\s)H(?:\s|$)')} then 'high' when {_has('text', r'[↓⬇▼]|偏低|降低|(?i:\blow\b)|(?:^|\s)L(?:\s|$)')} then 'low' when {_has('text', r'\*|异常|(?i:abnormal)|阳性')} then 'abnormal' end as f from lines)
        select line_id, coalesce(n, -1) as number, coalesce(lo, -1) as low, coalesce(hi, -1) as high, coalesce(f, '') as flag,
          coalesce(case when n > hi then 'high' when n < lo then 'low' when (lo is not null or hi is not null) and n is not null and f in ('high', 'low') then 'normal' else f end, '') as corrected,
          least(greatest(value, 2.0), 50.0) as clamped, floor(n + 0.5) as whole, case when n is null then 'excluded' when n * 10 >= 90 then 'high' when n * 10 >= 65 then 'medium' else 'low' end as bucket,
          case when abs(n / 3) >= 100 then printf('%.0f', n / 3) when abs(n / 3) >= 10 then printf('%.1f', n / 3) when n is not null then printf('%.2f', n / 3) end as shown
        from n
    """,
    "token_budgets": f"""
        with {LINES}, r as (select report_id, count(distinct page_number) as p, count(*) filter ({_ROLE['candidate']}) as c, count(*) filter ({_ROLE['morphology']}) as m, sum(length(text)) as n from lines group by 1),
        e as (select report_id, 768 + 96 * p + 100 * c + 180 * m + least(768, ceil(n / 8)) as estimate from r)
        select report_id, cast(estimate as bigint) as estimate, cast(least(greatest(ceil(estimate * 1.35 / 1024) * 1024, 2048), 12000) as bigint) as budget from e
    """,
    "sizes_in_text": f"""
        with {LINES}, s as (select line_id, {", ".join(f"{_cut('text', _SIZE, i)} as g{i}" for i in range(1, 6))} from lines where {_has('text', _SIZE)}),
        v as (select line_id, cast(g1 as double) as length, cast(g3 as double) as width, {_double('g4')} as height, case coalesce(nullif(g5, ''), nullif(g2, '')) when 'cm' then 'cm' when '厘米' then 'cm' when 'mm' then 'mm' when '毫米' then 'mm' else '' end as unit from s)
        select line_id, length, width, coalesce(height, -1) as height, unit, case unit when 'cm' then 10 * greatest(length, width, coalesce(height, 0)) when 'mm' then greatest(length, width, coalesce(height, 0)) else -1 end as largest,
          case unit when 'cm' then 10 else 1 end * greatest(length, width, coalesce(height, 0)) as most, case when height is null then 2 else 3 end as sides from v
    """,
    "dates_in_text": f"""
        with {LINES} select line_id, coalesce({_day('text')}, '') as found, coalesce({_day(_cut('text', '报告日期' + _TAIL, 1))}, {_day(_cut('text', '检查日期' + _TAIL, 1))}, '') as labelled,
          strftime(ts, '%Y-%m-%d %H:%M') as given, case when {_has('substring(text, -10, 10)', _OK)} then substring(text, -10, 10) else '' end as tail, strftime(ts, '%Y-%m-%d') as day from lines
    """,
    "units_of_values": f"""
        with {LINES}, u as (select line_id, [{", ".join(map(_q, _ANALYTES))}][member_id % {len(_ANALYTES)} + 1] as key, ['mg/dL', 'mmol/L', 'cm', 'mm', 'μmol/L', 'g/dL', '', '10^9/L', 'furlong'][line_id % {len(_SPELLINGS)} + 1] as unit,
            [{", ".join(map(_q, _TARGETS))}][(line_id + member_id) % {len(_TARGETS)} + 1] as wanted, value from lines),
        c as (select *, case when unit = '' then null when unit = wanted then value when unit = 'cm' and wanted = 'mm' then value * 10 when unit = 'mm' and wanted = 'cm' then value / 10
            {" ".join(f"when key in ({', '.join(map(_q, keys))}) and unit = {_q(a)} and wanted = {_q(b)} then value {'/' if op == 'divide' else '*'} {f} when key in ({', '.join(map(_q, keys))}) and unit = {_q(b)} and wanted = {_q(a)} then value {'*' if op == 'divide' else '/'} {f}" for keys, a, b, op, f in U.CONVERSIONS)} end as v from u)
        select line_id, key, unit, wanted, v is not null as can, round(coalesce(v, -1), 4) as converted from c
    """,
    "line_roles": f"""
        with {LINES} select line_id, coalesce({_ROLE['boundary']}, '') as boundary, {_ROLE['candidate']} as candidate, {_ROLE['morphology']} as morphology, {_ROLE['non_result']} as non_result,
          {_has('s', r'^(?:第?\d+页(?:共\d+页)?|\d+/\d+页?|-?\d+-?|本报告仅供.*|仅供临床参考.*|打印时间.*|打印日期.*|以下空白)$')} or not {_has('s', r'[\p{L}\p{N}]')} or (line_id % 3 = 0 and length(s) <= 2) as noise
        from (select *, {_NOISE} as s from lines)
    """,
    "identifiers_in_lines": f"""
        with {LINES} select line_id, {", ".join(f"case when line_id % {len(IDENTIFIER_LABELS)} = {n} and line_id % 3 > 0 then 'A-' || line_id else '' end as id{n}" for n in range(3))} from lines
    """,
    "pages_to_read": f"""
        with {LINES}, p as (select report_id, page_number, count(*) * 4 as n, sum(length(text)) * 10 as c, max(value) / 1000 as v from lines group by 1, 2)
        select report_id, page_number, n < 8 or c < 300 or v >= 0.18 or (v >= 0.06 and c < 1500) as read from p
    """,
    "log_pages": f"""
        with {LINES} select ['ocr', 'extraction', 'upload', 'backup', 'database', 'dictionary', 'system'][line_id % {len(_MESSAGES)} + 1] as kind, event_type, count(*) as n from lines group by 1, 2
    """,
}
