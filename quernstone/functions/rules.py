"""Rule tables compiled to expressions: ordered first match, and weighted sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """The label of the first pattern that is found in a text.

    The text is bound once, as the variable of a lambda: otherwise its expression is evaluated, and compiled, for each rule.
    """
    if not rules:
        return default if default is not None else F.lit(None).cast("string")

    def chain(t: Column) -> Column:
        out = F.when(t.rlike(rules[0][0]), rules[0][1])
        for pattern, label in rules[1:]:
            out = out.when(t.rlike(pattern), label)
        return out

    found = F.get(F.transform(F.array(text), chain), F.lit(0))
    return F.coalesce(found, default) if default is not None else found


def weighted_sum(text: Column, rules: Sequence[tuple[str, float]]) -> Column:
    """The weights of all patterns that are found in a text, summed."""
    total = F.lit(0.0)
    for pattern, weight in rules:
        total = total + F.when(text.rlike(pattern), float(weight)).otherwise(0.0)
    return total


def scores_by_kind(text: Column, signals: dict[str, Sequence[tuple[str, float]]]) -> Column:
    """An array of ``kind, score`` for each kind of a table of weighted signals."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), weighted_sum(text, rules).alias("score")) for k, rules in signals.items()])


def finish_classification(scores: Column) -> Column:
    """The best one or two kinds of an array of ``kind, score``, and a confidence.

    The second counts when it has at least 6 and 0.55 of the top. Confidence is the top's share of
    itself and 0.65 of the second, from 0.25 to 1, to three decimals. Of equal scores the kind that
    comes first in the array wins. Without a score above 0 the kind is ``other``.
    """
    found = F.filter(F.transform(scores, lambda x, i: F.struct((-x["score"]).alias("minus"), i.alias("at"), x["kind"].alias("kind"))), lambda x: x["minus"] < 0)
    ranked = F.array_sort(found)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    first_score, second_score = F.coalesce(-top["minus"], F.lit(0.0)), F.coalesce(-second["minus"], F.lit(0.0))
    both = second_score >= F.greatest(F.lit(6.0), first_score * 0.55)
    kinds = F.when(F.size(ranked) == 0, F.array(F.lit("other"))).when(both, F.array(top["kind"], second["kind"])).otherwise(F.array(top["kind"]))
    share = first_score / F.greatest(F.lit(1.0), first_score + second_score * 0.65)
    confidence = F.when(F.size(ranked) == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.25), F.least(F.lit(1.0), share)), 3))
    return F.struct(kinds.alias("kinds"), confidence.alias("confidence"))


def anchored(scores: Column, kind: str, anchor: Column) -> Column:
    """Lift a kind one above all others where an anchor was seen."""
    best = F.array_max(F.transform(F.filter(scores, lambda x: x["kind"] != kind), lambda x: x["score"]))
    lifted = F.transform(scores, lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"] == kind, F.greatest(x["score"], F.coalesce(best, F.lit(0.0)) + 1)).otherwise(x["score"]).alias("score")))
    return F.when(anchor, lifted).otherwise(scores)
