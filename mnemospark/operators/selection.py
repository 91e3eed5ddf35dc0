"""Choice of features by correlation: one pass over the rows gives all pairs, the choice itself sees that matrix only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_a, feature_b, correlation) of all pairs of columns, in one aggregate; null where one doesn't vary."""

    def one(a: str, b: str):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))  # the built-in correlation fails where nothing varies

    pairs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), one(a, b).alias("correlation")) for a, b in combinations(columns, 2)]
    return rows.agg(F.array(*pairs).alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*")


def _matrix(table: list[tuple[str, str, float | None]]) -> dict[tuple[str, str], float]:
    return {key: abs(c or 0.0) for a, b, c in table for key in ((a, b), (b, a))}


def correlation_filter(table: list[tuple[str, str, float | None]], importance: dict[str, float], threshold: float = 0.85) -> list[str]:
    """The features left after dropping, of each pair beyond the threshold, the less important one; of equals the later."""
    corr, kept = _matrix(table), list(importance)
    for a, b in combinations(list(importance), 2):
        if a in kept and b in kept and corr.get((a, b), 0.0) > threshold:
            kept.remove(b if importance[a] >= importance[b] else a)
    return kept


def most_relevant(table: list[tuple[str, str, float | None]], target: str, k: int) -> list[str]:
    """k features by greatest relevance and least redundancy: correlation with the target less the mean one with those chosen before.

    Ties go to the name that comes first.
    """
    corr = _matrix(table)
    left, chosen = sorted({x for key in corr for x in key} - {target}), []
    while left and len(chosen) < k:
        worth = lambda f: corr[(f, target)] - (sum(corr[(f, c)] for c in chosen) / len(chosen) if chosen else 0.0)
        best = max(left, key=lambda f: (round(worth(f), 12), [-ord(c) for c in f]))
        chosen.append(best)
        left.remove(best)
    return chosen
