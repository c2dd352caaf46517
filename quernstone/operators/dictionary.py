"""The indicator dictionary: layers, checks, differences, activation, and where a series belongs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import narrow
from quernstone.sources.tables import cut

from .diffs import snapshot_diff
from .normalize import DICTIONARY_ROWS


def compact_alias(name: Column) -> Column:
    """An alias as a key: narrow, lower case, without spaces and punctuation; a plus stays."""
    return F.regexp_replace(F.lower(narrow(name)), r"[（）()：:，,。.;；、|\s_-]", "")


def merge_layers(core: DataFrame, remote: DataFrame, redirects: DataFrame) -> DataFrame:
    """Core and remote indicators as one dictionary.

    Both have ``canonical_key`` and the same columns. A remote entry never replaces one of the core; entries that
    are redirected elsewhere (``from_key, to_key``) are left out. Adds ``layer``.
    """
    a = core.withColumn("layer", F.lit("core"))
    b = remote.join(core.select("canonical_key"), "canonical_key", "left_anti").withColumn("layer", F.lit("remote"))
    return a.unionByName(b, allowMissingColumns=True).join(redirects.select(F.col("from_key").alias("canonical_key")), "canonical_key", "left_anti")


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """``from_key, to_key`` with chains followed to their ends, however long; of several redirects of a key the smallest target counts.

    Each round doubles the steps that a row has gone. A chain has settled once the steps exceed the number of redirects; what has not by then
    runs in a circle, or into one, and keeps a target that is itself redirected. Null keys are left out.
    """
    ends = cut(redirects.filter("from_key is not null and to_key is not null").groupBy("from_key").agg(F.min("to_key").alias("to_key")))
    most, steps = ends.count(), 1
    while steps <= most:
        further = ends.select(F.col("from_key").alias("to_key"), F.col("to_key").alias("beyond"))
        gone = cut(ends.join(further, "to_key", "left").select("from_key", F.coalesce("beyond", "to_key").alias("to_key"), F.col("beyond").isNotNull().alias("moved")))
        ends, steps = gone.select("from_key", "to_key"), 2 * steps
        if gone.filter("moved").isEmpty():
            break
    return ends


def validate(indicators: DataFrame, aliases: DataFrame, categories: DataFrame, redirects: DataFrame) -> DataFrame:
    """What is wrong with a dictionary: ``problem, subject``.

    Repeated keys, unknown categories, aliases of unknown keys, aliases that several keys share in one scope, places in
    the order that categories share, redirects to nowhere and redirects that run in a circle.
    """
    keys = indicators.select("canonical_key")
    say = lambda df, problem, subject: df.select(F.lit(problem).alias("problem"), F.col(subject).cast("string").alias("subject"))
    repeated = indicators.groupBy("canonical_key").count().filter("count > 1")
    homeless = indicators.join(categories.select("category"), "category", "left_anti")
    dangling = aliases.join(keys, "canonical_key", "left_anti")
    shared = aliases.select(compact_alias(F.col("alias")).alias("name"), "scope", "canonical_key").distinct().groupBy("name", "scope").count().filter("count > 1")
    clash = categories.groupBy("group", "item_order").count().filter("count > 1").withColumn("place", F.concat_ws("#", "group", "item_order"))
    nowhere = redirects.join(redirects.select(F.col("from_key").alias("to_key")), "to_key", "left_anti").join(keys.withColumnRenamed("canonical_key", "to_key"), "to_key", "left_anti")
    ends = resolve_redirects(redirects)
    circle = ends.join(redirects.select(F.col("from_key").alias("to_key")), "to_key", "left_semi")
    found = [
        say(repeated, "repeated_key", "canonical_key"), say(homeless, "unknown_category", "canonical_key"), say(dangling, "unknown_key", "alias"), say(shared, "ambiguous_alias", "name"),
        say(clash, "order_clash", "place"), say(nowhere, "redirect_to_nowhere", "from_key"), say(circle, "redirect_circle", "from_key"),
    ]
    return reduce(DataFrame.unionByName, found)


def dictionary_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Added, removed and updated indicators, counted: ``change, n, keys`` (sorted)."""
    d = snapshot_diff(old, new, "canonical_key", columns)
    return d.groupBy("change").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("canonical_key")).alias("keys"))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table's rows, in any order and as often as they occur: ``digest, n``.

    Row digests are cut into four numbers, which are summed, so nothing is gathered in one task.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    piece = lambda k: F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = df.select(row.alias("h")).agg(F.concat_ws(",", *[F.coalesce(piece(k), F.lit("0")) for k in range(4)]).alias("sums"), F.count("*").alias("n"))
    return sums.select(F.sha2(F.concat_ws(":", "sums", F.col("n").cast("string")), 256).alias("digest"), "n")


def layer_counts(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("layer").agg(F.count("*").alias("n"))


def place(observations: DataFrame, categories: DataFrame, groups: DataFrame, kinds: DataFrame) -> DataFrame:
    """Where an observation belongs: by its category, else by a hint in its section's name, else by the report's kind.

    ``observations``: ``id, category, section_name, report_type``; ``categories``: ``category, group, subgroup``; ``groups``: ``group, hints,
    item_order``; ``kinds``: ``report_type, group``. Adds ``group, subgroup, placed_by, confidence``. Every join is by equality, so
    Spark broadcasts the taxonomies while they are small.
    """
    c = categories.select("category", F.col("group").alias("__cg"), "subgroup")
    out = observations.join(c, "category", "left")
    hints = _sent(groups.select(F.col("group").alias("__hg"), "item_order", F.explode("hints").alias("hint")))
    section = observations.filter("section_name is not null").select("id", compact_alias(F.col("section_name")).alias("s"))
    met = mentions(section, "s", hints.withColumn("name", compact_alias(F.col("hint")))).groupBy("id").agg(F.min_by("__hg", F.struct(-F.length("hint"), "item_order")).alias("__hg"))
    out = out.join(met.hint("merge"), "id", "left").join(kinds.select("report_type", F.col("group").alias("__kg")), "report_type", "left")
    by = F.when(F.col("__cg").isNotNull(), "category").when(F.col("__hg").isNotNull(), "section").when(F.col("__kg").isNotNull(), "report")
    return out.select(
        *observations.columns, F.coalesce("__cg", "__hg", "__kg").alias("group"), "subgroup", by.alias("placed_by"),
        F.when(by == "category", 95).when(by == "section", 80).when(by == "report", 50).otherwise(0).alias("confidence"),
    )


def _sent(names: DataFrame) -> DataFrame:
    """Names of up to ``DICTIONARY_ROWS`` go to every task; more are joined by a shuffle. Texts, however small their files, are never sent."""
    return F.broadcast(names) if names.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS else names.hint("merge")


def mentions(texts: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """Texts with each ``name`` that they hold: a row for each such pair.

    Candidates meet by the first two characters of the name (or its only one), so this is an equality join, not a loop over
    texts and names; then the whole name is looked for.
    """
    each = F.sequence(F.lit(1), F.length(text))
    grams = F.array_distinct(F.flatten(F.transform(each, lambda i: F.array(F.substring(F.col(text), i, F.lit(1)), F.substring(F.col(text), i, F.lit(2))))))
    left = texts.filter(F.length(text) > 0).withColumn("__g", F.explode(grams))
    right = names.filter(F.length("name") > 0).withColumn("__g", F.substring("name", 1, 2))
    return left.join(right, "__g").filter(F.contains(F.col(text), F.col("name"))).drop("__g")


def facts_for_lines(lines: DataFrame, aliases: DataFrame, most: int = 8) -> DataFrame:
    """Entries of the dictionary that lines mention: ``line_id, canonical_key, alias``, the longest aliases first, ``most`` a line.

    A code in Latin letters must stand as a word; another name must be the first cell of a table row, or occur in
    other text. Words and cells are joined by equality, names in text by their first two characters (``mentions``).
    """
    cell = F.trim(F.get(F.split("text", r"[|｜]"), F.lit(0)))
    rows = lines.select("line_id", cell.alias("cell"), F.col("text").rlike(r"[|｜]").alias("table"), "text")
    names = _sent(aliases.select("canonical_key", "alias", compact_alias(F.col("alias")).alias("name")).filter("name <> ''"))
    code = F.col("name").rlike(r"^[a-z][a-z0-9.+#%]{0,15}$")
    words = rows.select("line_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(narrow(F.col("cell"))), F.lit(r"([a-z][a-z0-9.+#%]*)"), 1))).alias("name"))
    by_code = words.join(names.filter(code & (F.length("name") >= 2)), "name")
    cells = rows.filter("table").select("line_id", compact_alias(F.col("cell")).alias("name"))
    by_cell = cells.join(names.filter(~code), "name")
    text = rows.filter("not table").select("line_id", compact_alias(F.col("text")).alias("t"))
    by_text = mentions(text, "t", names.filter(~code)).select("name", "line_id", "canonical_key", "alias")
    met = by_code.unionByName(by_cell).unionByName(by_text).groupBy("line_id", "canonical_key").agg(F.max_by("alias", F.struct(F.length("name"), "alias")).alias("alias"))
    w = Window.partitionBy("line_id").orderBy(F.length("alias").desc(), "canonical_key")
    return met.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")
