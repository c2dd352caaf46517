"""Resolution of not-modified revisits in a web archive.

A revisit record says that a page had not changed since an earlier capture and has no body
of its own. It is resolved to the latest earlier full response of the same canonical URL,
if the validators of both agree; the stored response's headers are then updated by those
of the revisit that such an answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

# Fields that a not-modified answer never updates in a stored response
# (RFC 9111, section 3.2, and connection-level fields), in lower case.
NEVER_MERGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)

#: A URL with more captures than this is cut into so many slices of about as many captures each.
HOT, SLICES = 100_000, 256


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, ``user@`` and the usual port; no scheme, fragment, session or
    tracking parameters; no slash at the end. A null stays null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, "^[^/?@]*@", "")
    host = F.regexp_extract(u, "^[^/?]*", 0)
    rest = F.substring(u, F.length(host) + 1, F.length(u))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref|gclid|fbclid|sessionid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]+$", "")
    rest = F.regexp_replace(rest, "/+$", "")
    return F.concat(host, rest)


def weak_etag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.nullif(F.regexp_replace(F.trim(tag), "^W/", ""), F.lit(""))


def fields(headers: Column) -> Column:
    """Header fields as an array of names and values, in the order of names, which are in lower case.

    Fields whose names differ in case or in white space around them are one, with the values joined by commas in the
    order in which the names were written. A field without a value counts as absent; null headers have none.
    """
    some = F.filter(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda x: x["value"].isNotNull())
    name = lambda x: F.lower(F.trim(x["key"]))
    values = lambda n: F.transform(F.array_sort(F.filter(some, lambda x: name(x) == n)), lambda x: x["value"])
    names = F.array_sort(F.array_distinct(F.transform(some, name)))
    return F.transform(names, lambda n: F.struct(n.alias("key"), F.array_join(values(n), ", ").alias("value")))


def merge_fields(stored: Column, revisit: Column) -> Column:
    """The stored fields, as ``fields`` gives them, updated by those of a not-modified answer that may change them."""
    allowed = F.filter(revisit, lambda x: ~x["key"].isin(*NEVER_MERGED))
    new = F.transform(allowed, lambda x: x["key"])
    return F.concat(F.filter(stored, lambda x: ~F.array_contains(new, x["key"])), allowed)


def resolve_revisits(captures: DataFrame, hot: int = HOT, slices: int = SLICES) -> DataFrame:
    """Resolve every revisit among captures.

    ``captures`` has ``record_id``, ``url``, ``ts`` (a number or timestamp), ``kind``
    (``response`` or ``revisit``), ``etag``, ``last_modified``, ``digest`` and ``headers`` (a map; names in
    any case). Returns one row for each revisit: ``record_id, canonical, ts,
    response_id, status, digest, headers``, with names in lower case. ``status`` is

    * ``resolved``: entity tags are equal (weak comparison), or, when the revisit has none, the
      dates of last modification are;
    * ``validator_mismatch``: a tag or date differs; ``response_id`` is given, digest and headers are not;
    * ``no_validator``: nothing to compare by;
    * ``no_response``: no full response of this URL is earlier (also for a null URL or time).

    A response at the very time of a revisit is not earlier. Of responses with equal times the one
    with the largest ``record_id`` counts as latest, and of rows that agree in that too the one with the largest tag,
    date, digest and fields, in this order (null first). Each revisit is resolved with its own row's headers, whatever
    other rows its ``record_id`` has, so a repeated revisit has a row for each time. An empty table gives an empty
    result; other columns are not looked at.

    As-of join: one window for each URL, in the order of time, carries the last response along. The captures of a URL
    with more than ``hot`` of them are cut at quantiles of their times into ``slices`` windows; a slice without a
    response takes the last one of an earlier slice, of which there is one row each. So a URL with a third of all
    captures is many groups, whatever its times; only captures of one URL and one time are never parted.
    """
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", F.col("ts").cast("double").alias("at"), "kind",
        weak_etag(F.col("etag")).alias("etag"), "last_modified", "digest", fields(F.col("headers")).alias("fields"),
    )
    usable = rows.filter("canonical is not null and at is not null and kind in ('response', 'revisit')")
    cuts = _cuts(usable, hot, slices)
    parts = ["canonical"] if cuts is None else ["canonical", "slice"]
    if cuts is not None:
        usable = usable.join(cuts, "canonical", "left")
        usable = usable.withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("at"))), F.lit(0))).drop("cuts")
    order = ["at", "record_id", "etag", "last_modified", "digest", "fields"]
    response = F.when(F.col("kind") == "response", F.struct(*order))
    # At equal times revisits sort before responses, so a running "last response" is strictly earlier.
    running = Window.partitionBy(*parts).orderBy("at", F.col("kind").desc(), *order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = usable.withColumn("r", F.last(response, ignorenulls=True).over(running)).filter("kind = 'revisit'")
    if cuts is not None:
        found = found.join(_carried(usable), parts, "left").withColumn("r", F.coalesce("r", "carried"))
    same = lambda c: F.when(F.col(c) == F.col(f"r.{c}"), "resolved").otherwise("validator_mismatch")
    both = lambda c: F.col(c).isNotNull() & F.col(f"r.{c}").isNotNull()
    status = F.when(F.col("r").isNull(), "no_response").when(both("etag"), same("etag")).when(both("last_modified"), same("last_modified")).otherwise("no_validator")
    lost = rows.filter("kind = 'revisit' and (canonical is null or at is null)").withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    out = found.select(*lost.columns).unionByName(lost).withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return out.select(
        "record_id", "canonical", "ts", F.col("r.record_id").alias("response_id"), "status", F.when(resolved, F.col("r.digest")).alias("digest"),
        F.when(resolved, F.map_from_entries(merge_fields(F.col("r.fields"), F.col("fields")))).alias("headers"),
    )


def _cuts(usable: DataFrame, hot: int, slices: int) -> DataFrame | None:
    """Quantiles of the times of each URL with more than ``hot`` captures; none if there is no such URL."""
    counts = usable.groupBy("canonical").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    often = cut(counts.select("canonical"))
    if often.isEmpty():
        return None
    at = [i / slices for i in range(1, slices)]
    return cut(usable.join(often, "canonical", "left_semi").groupBy("canonical").agg(F.array_distinct(F.percentile_approx("at", at, 10_000)).alias("cuts")))


def _carried(usable: DataFrame) -> DataFrame:
    """The latest response of all earlier slices, for each slice that has captures; written, so that a large slice can be split."""
    order = F.struct("at", "record_id", "etag", "last_modified", "digest", "fields")
    last = usable.groupBy("canonical", "slice").agg(F.max(F.when(F.col("kind") == "response", order)).alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return cut(last.select("canonical", "slice", F.last("last", ignorenulls=True).over(before).alias("carried")))
