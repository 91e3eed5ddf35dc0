"""Column expressions for scores: decay, priors, exploration, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.config import MAINTENANCE, SCORING, Maintenance, Scoring


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time with or without zone; sessions run in UTC."""
    return F.unix_micros(time.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 86_400e6


def decay_rate(rate: Column, category: Column, params: Maintenance = MAINTENANCE) -> Column:
    """The own rate, else the category's, else the default."""
    table = F.create_map(*[F.lit(x) for pair in params.decay_rates.items() for x in pair])
    return F.coalesce(rate, table[category], F.lit(params.decay_default))


def effective_priority(base: Column, last: Column, rate: Column, category: Column, flags: Column, now: Column, params: Maintenance = MAINTENANCE) -> Column:
    """Priority after exponential decay, at least its floor; pinned and kept ones don't decay, nor do the timeless."""
    own = decay_rate(rate, category, params)
    base = base.cast("double")
    immune = F.coalesce(F.arrays_overlap(flags, F.array(F.lit("pinned"), F.lit("keep"))), F.lit(False))
    days = F.greatest(F.lit(0.0), days_between(now, last))
    return F.when(immune | (own == 0) | last.isNull(), base).otherwise(F.greatest(base * F.exp(-own * days), base * params.decay_floor))


def reciprocal_rank(rank: Column, k: float, weight: float) -> Column:
    """Share of a channel in the fused score for a 0-based rank; nothing where the channel doesn't list the item."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank + 1), F.lit(0.0))


def exploration(ewma: Column, count: Column, prior_mean: Column, prior_strength: Column, params: Scoring = SCORING) -> Column:
    """Factor 1 + c * standard deviation of the Beta posterior; without feedback that of the prior."""
    most = 1 / (2 * params.ewma_alpha - params.ewma_alpha**2)
    seen = F.when(count.isNull(), 0.0).otherwise(F.least(count.cast("double"), F.lit(most)))
    mean = F.coalesce(ewma, F.lit(0.0))
    a = mean * seen + prior_mean * prior_strength
    b = (1 - mean) * seen + (1 - prior_mean) * prior_strength
    return 1 + params.ucb * F.sqrt(F.greatest(F.lit(0.0), a * b) / ((a + b) * (a + b) * (a + b + 1)))
