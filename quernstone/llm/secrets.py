"""Secret scanning with ownership frequency.

Candidates come from three patterns. Each candidate's hash is counted over the corpus by
distinct repositories and owners: what many owners share, or what is in many repositories,
is an example copied from documentation; what one owner alone has, in few repositories,
and looks random is likely live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from .common import cut, map_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "live", "shared", "example")


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Kind, start and end of each base match, and start and end of its secret, in code points.

    A greedy run that is too short is also too short from any later start, so for the two
    run patterns the least length is part of the pattern. An assignment may consume the key
    word of the next one, so there the value's length is checked after matching.
    """
    found = [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def bits_per_char(value: str) -> float:
    """Shannon entropy of a string's characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str, least_bits: float = 2.8) -> bool:
    """Random-looking: mixed or hexadecimal, and of enough entropy."""
    digits = sum(c.isdigit() for c in value)
    return 0 < digits < len(value) and bits_per_char(value) >= least_bits


_CANDIDATE = StructType(
    [
        StructField("kind", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("from", IntegerType()),
        StructField("to", IntegerType()),
        StructField("secret", StringType()),
        StructField("random", BooleanType()),
    ]
)
_FIELDS = StructType(
    [
        StructField("n_assign", LongType()),
        StructField("n_access", LongType()),
        StructField("n_hex", LongType()),
        StructField("base", StringType()),
        StructField("candidates", ArrayType(_CANDIDATE)),
    ]
)


def candidates(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add counts, the listed base spans, and the candidates with a hash of each secret (never the secret)."""

    def factory():
        def work(column: pa.Array) -> list[pa.Array]:
            counts: list[list[int]] = [[], [], []]
            base, items = [], []
            for t in column.to_pylist():
                spans = base_spans(t or "")
                for c, kind in zip(counts, KINDS, strict=False):
                    c.append(sum(s[0] == kind for s in spans))
                base.append(",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in spans))
                items.append(
                    [
                        {"kind": k, "start": a, "end": b, "from": x, "to": y, "secret": hashlib.sha256(t[x:y].encode()).hexdigest(), "random": looks_live(t[x:y])}
                        for k, a, b, x, y in spans
                    ]
                )
            return [*[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(items, _ITEMS)]

        return work

    return map_text(df, text_col, _FIELDS, factory, keep)


_ITEMS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("from", pa.int32()), ("to", pa.int32()), ("secret", pa.string()), ("random", pa.bool_())])
)


def ownership(found: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """For each secret's hash: occurrences, distinct repositories and distinct owners.

    Distinct pairs are made first, so a secret in a third of all rows is spread by its repositories.
    """
    pairs = found.groupBy("secret", F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner")).agg(F.count("*").alias("n"))
    repos = pairs.groupBy("secret", "repo").agg(F.sum("n").alias("n")).groupBy("secret").agg(F.sum("n").alias("n"), F.count("repo").alias("n_repos"))
    owners = pairs.select("secret", "owner").distinct().groupBy("secret").agg(F.count("owner").alias("n_owners"))
    return repos.join(owners, "secret")


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str | None = None,
    owner_col: str = "source",
    example_owners: int = 3,
    example_repos: int = 10,
) -> DataFrame:
    """Find secrets and tell live-looking ones from copied examples.

    Returns one row for each input row: ``doc_id, n_assign, n_access, n_hex, base_sha256,
    spans``. ``spans`` lists ``kind:start:end`` of the base matches and, for each secret in them,
    one of

    * ``example``: ``example_owners`` owners or more have it, or ``example_repos`` repositories or more;
    * ``live``: it looks random and one owner has it (or none is known), in fewer repositories;
    * ``shared``: it looks random and several owners have it, though fewer than make an example.

    What does not look random and is no example has no span of its own. ``repo_col`` defaults to the id:
    each document is a repository of its own.

    A null or empty text has no matches. Rows of a null owner or id count as no owner or repository. Rows
    that repeat an id are scanned one by one. Texts are scanned whole; an empty table gives an empty
    result; other columns are not looked at.
    """
    owned = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
    )
    found = candidates(owned, "text", ["doc_id", "repo", "owner"])
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    each = found.filter(F.size("candidates") > 0).select("row", "repo", "owner", F.explode("candidates").alias("c"))
    each = each.select("row", "repo", "owner", F.col("c.from").alias("from"), F.col("c.to").alias("to"), F.col("c.secret").alias("secret"), F.col("c.random").alias("random"))
    owners = cut(ownership(each, "repo", "owner"))  # written, so that the join is of plain shuffles and a frequent secret is split
    judged = each.join(owners, "secret").withColumn(
        "kind",
        F.when((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos), "example").when(
            F.col("random"), F.when(F.col("n_owners") <= 1, "live").otherwise("shared")
        ),
    )
    added = judged.filter("kind is not null").groupBy("row").agg(F.collect_set(F.struct("from", "kind", "to")).alias("added"))
    out = found.join(added, "row", "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform("candidates", lambda c: F.struct(c["start"].alias("a"), F.array_position(order, c["kind"]).alias("k"), c["end"].alias("b"))),
                F.coalesce(
                    F.transform("added", lambda c: F.struct(c["from"].alias("a"), F.array_position(order, c["kind"]).alias("k"), c["to"].alias("b"))),
                    F.array().cast("array<struct<a:int,k:bigint,b:int>>"),
                ),
            )
        )
    )
    listed = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(order, s["k"].cast("int") - 1), s["a"], s["b"])), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), listed.alias("spans"))
