"""Keys, identifiers and redaction of free text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Full-width forms and the ideographic space, and what compatibility normalisation makes of them.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

BRACKETS = r"[(（\[【{][^()（）\[\]【】{}]*[)）\]】}]"
SPACE_PUNCT = r"[\s\p{P}\p{S}]+"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Full Unicode compatibility normalisation, in Arrow batches. Spark has no function for it."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def narrow(text: Column) -> Column:
    """Full-width characters to their usual forms: the part of NFKC that most keys need, as a built-in."""
    return F.translate(text, _WIDE, _NARROW)


def indicator_key(name: Column) -> Column:
    """Name of an indicator as a key: lower case, without bracketed remarks, spaces and punctuation; a plus stays."""
    bare = F.regexp_replace(F.lower(narrow(name)), BRACKETS, "")
    return F.regexp_replace(bare, r"[\s\p{P}\p{S}&&[^+]]+", "")


def qualified_key(name: Column) -> Column:
    """As ``indicator_key``, with the text in brackets kept."""
    return F.regexp_replace(F.lower(narrow(name)), r"[\s\p{P}\p{S}&&[^+]]+", "")


def content_key(text: Column) -> Column:
    """Lower case without spaces and punctuation; null counts as empty."""
    return F.regexp_replace(F.lower(narrow(F.coalesce(text, F.lit("")))), SPACE_PUNCT, "")


def name_variants(name: Column) -> Column:
    """Distinct keys that a name may be listed under: whole, without brackets, the bracketed code, a leading or trailing code."""
    plain = F.trim(narrow(name))
    code = r"([A-Za-z][A-Za-z0-9%#+-]*)"
    inner = F.regexp_extract(plain, r"[(\[{（【]\s*" + code + r"\s*[)\]}）】]", 1)
    head = F.regexp_extract(plain, "^" + code + r"[\s\-:：]+[^A-Za-z].*$", 1)
    tail = F.regexp_extract(plain, r"^[^A-Za-z]+?[\s\-:：]*" + code + "$", 1)
    keys = F.array(qualified_key(name), indicator_key(name), *[F.regexp_replace(F.lower(x), r"[\s-]+", "") for x in (inner, head, tail)])
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def trimmed(text: Column, most: int) -> Column:
    """Trimmed and cut to a length; null when nothing is left."""
    return F.nullif(F.substring(F.trim(text), 1, most), F.lit(""))


def file_name(name: Column) -> Column:
    """A stored file name without control characters and path separators, 180 characters at most."""
    return F.substring(F.regexp_replace(name, r"[\x00-\x1F\x7F/\\]+", "_"), 1, 180)


def line_key(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def line_fingerprint(text: Column) -> Column:
    """A key that repeated headers and footers share: numbers are masked."""
    return F.regexp_replace(F.regexp_replace(F.lower(narrow(text)), r"\d+", "#"), r"\s+", "")


def abbreviate_id(id_: Column) -> Column:
    return F.when(F.length(id_) <= 12, id_).otherwise(F.concat(F.substring(id_, 1, 6), F.lit("…"), F.substring(id_, -4, 4)))


def table_cells(line: Column) -> Column:
    """Cells of a table row, trimmed."""
    return F.transform(F.split(line, r"[|｜]"), lambda c: F.trim(c))


def similar_text(a: Column, b: Column, least: int = 12, prefix: int = 40) -> Column:
    """Equal, or one holds the first characters of the other; short texts never match."""
    x, y = content_key(a), content_key(b)
    long_enough = (F.length(x) >= least) & (F.length(y) >= least)
    return long_enough & ((x == y) | F.contains(x, F.substring(y, 1, prefix)) | F.contains(y, F.substring(x, 1, prefix)))


def same_institution(a: Column, b: Column) -> Column:
    """Equal names, or one within the other when both are long and of similar length."""
    x, y = content_key(a), content_key(b)
    low, high = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    within = F.contains(x, y) | F.contains(y, x)
    return (x != "") & (y != "") & ((x == y) | ((low >= 6) & (low / high >= 0.55) & within))


def labelled_value(text: Column, label: str) -> Column:
    """The identifier behind a label: 3 characters or more; null without one."""
    value = F.regexp_extract(text, label + r"\s*[:：#]?\s*([A-Za-z0-9][A-Za-z0-9_-]{2,})", 1)
    return F.nullif(value, F.lit(""))


# Patterns of personal data and what stands in for them, in the order of application.
# They use no look-around, so that any SQL engine can apply the same rules.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b\d{17}[0-9Xx]\b", "[id]"),
    (r"\b1[3-9]\d{9}\b", "[mobile]"),
    (r"\+?\d{1,3}[ -]\(?\d{2,4}\)?[ -]\d{3,4}[ -]\d{3,4}", "[phone]"),
    (r"\(?\b\d{3}\)?[ -]\d{3}-\d{4}\b", "[phone]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[ip]"),
)

# What must not reach a log, and what stands in for it.
LOG_REDACTIONS = (
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+", "$1 [redacted]"),
    (r"(?i)\b(api[_-]?key|token|secret|password|passwd|authorization)(\"?\s*[:=]\s*\"?)[^\s\",;}]+", "$1$2[redacted]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}", "[redacted]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b\d{17}[0-9Xx]\b", "[id]"),
    (r"\b1[3-9]\d{9}\b", "[mobile]"),
    (r"(/(?:home|Users|root|vol\d*)/)[^\s\"']+", "$1[path]"),
)


def redact(text: Column, rules: tuple[tuple[str, str], ...] = REDACTIONS) -> Column:
    """Apply redaction rules in order; all of them are built-in expressions in one projection.

    Personal data has a digit or an at sign in it, so a text without either isn't searched for any of the patterns.
    """
    out = text
    for pattern, mark in rules:
        out = F.regexp_replace(out, pattern, mark)
    return F.when(text.rlike(r"[@\d]"), out).otherwise(text) if rules is REDACTIONS else out


def drop_labelled_lines(text: Column, labels: list[str]) -> Column:
    """Leave out lines that begin with one of the labels and a colon."""
    pattern = r"^\s*(?:" + "|".join(labels) + r")\s*[:：]"
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(pattern)), "\n")


# Names under which trends of an indicator are known; each also stands for itself.
TREND_NAMES = {
    "白细胞计数": ("wbc", "白细胞", "白细胞数"),
    "红细胞计数": ("rbc", "红细胞", "红细胞数"),
    "血红蛋白": ("hgb", "hb", "血色素"),
    "血小板计数": ("plt", "血小板", "血小板数"),
    "空腹血糖": ("glu", "glucose", "血糖"),
    "总胆固醇": ("tc", "胆固醇"),
    "甘油三酯": ("tg", "三酰甘油"),
    "高密度脂蛋白胆固醇": ("hdl", "hdl-c", "高密度脂蛋白"),
    "低密度脂蛋白胆固醇": ("ldl", "ldl-c", "低密度脂蛋白"),
    "尿酸": ("ua",),
    "肌酐": ("crea", "creatinine"),
    "尿素氮": ("bun",),
    "丙氨酸氨基转移酶": ("alt", "谷丙转氨酶"),
    "天门冬氨酸氨基转移酶": ("ast", "谷草转氨酶"),
    "γ-谷氨酰转肽酶": ("ggt", "γ谷氨酰转肽酶"),
    "总胆红素": ("tbil",),
}


def trend_key(name: Column) -> Column:
    """A name as a key of trends: narrow, lower case, without remarks in round brackets, spaces and separators."""
    bare = F.regexp_replace(F.lower(narrow(name)), r"[（(].*?[）)]", "")
    return F.regexp_replace(bare, r"[\s：:，,。.;；、_-]+", "")


def trend_name(name: Column) -> Column:
    """The name under which an indicator's trend is shown: of the table of names, else its own with single spaces."""
    pairs = {re.sub(r"[\s_-]", "", alias): shown for shown, others in TREND_NAMES.items() for alias in (shown, *others)}
    known = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(known, trend_key(name)), F.trim(F.regexp_replace(name, r"\s+", " ")))
