"""Characters, free tiers, prices and budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.operators.prefix import fold_rows

#: Providers with the price of a million characters in USD and the free characters a month.
PRICES = {"deepl": (20.0, 500_000), "google": (20.0, 500_000), "openai": (15.0, 0), "grok": (15.0, 0)}
#: Characters a run may send.
RUN_BUDGET = 200_000


def price_table(spark) -> DataFrame:
    rows = [(name, price, free) for name, (price, free) in PRICES.items()]
    return spark.createDataFrame(rows, "provider string, cost_per_million double, free_tier long")


def cost(characters: Column, used: Column, free: Column, price: Column) -> Column:
    """What characters cost beyond the part of the free tier that is left."""
    left = F.greatest(free - F.coalesce(used, F.lit(0)), F.lit(0))
    return F.greatest(characters - left, F.lit(0)) / 1_000_000 * price


def live_cost(characters: Column, live_available: Column, live_used: Column, live_limit: Column, used: Column, free: Column, price: Column) -> Column:
    """The same with a provider's own figures where it gives them: its limit counts, and no limit means no cost."""
    left = (
        F.when(live_available & live_limit.isNotNull(), F.greatest(live_limit - live_used, F.lit(0)))
        .when(live_available, characters)
        .otherwise(F.greatest(free - F.coalesce(used, F.lit(0)), F.lit(0)))
    )
    return F.greatest(characters - left, F.lit(0)) / 1_000_000 * price


def characters(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("characters"))


def monthly_usage(log: DataFrame, provider: str = "provider", at: str = "ts", amount: str = "characters") -> DataFrame:
    """Characters by provider and month (YYYY-MM in the session's time zone)."""
    month = F.date_format(at, "yyyy-MM")
    return log.groupBy(F.col(provider).alias("provider"), month.alias("month")).agg(F.sum(amount).alias("characters"))


def estimates(usage: DataFrame, planned: DataFrame, prices: DataFrame, month: str) -> DataFrame:
    """provider, characters, used and estimate of planned characters given a month's usage."""
    own = usage.filter(F.col("month") == month).select("provider", F.col("characters").alias("used"))
    joined = planned.join(prices, "provider").join(own, "provider", "left")
    value = cost(F.col("characters"), F.col("used"), F.col("free_tier"), F.col("cost_per_million"))
    return joined.select("provider", "characters", F.coalesce("used", F.lit(0)).alias("used"), value.alias("estimate"))


def within_budget(items: DataFrame, keys: Sequence[str], order: str, size: str, budget: int = RUN_BUDGET) -> DataFrame:
    """The items with admitted and used: in order, an item is admitted if it fits what is left; a later, smaller one may
    still fit. A running sum can't say that, so a run's sizes are folded one after the other. A null size counts as 0."""

    def run() -> Callable[[int], tuple[bool, int]]:
        used = 0

        def step(n: int) -> tuple[bool, int]:
            nonlocal used
            fits = used + n <= budget
            used += n if fits else 0
            return fits, used

        return step

    amount = F.coalesce(F.col(size), F.lit(0)).cast("long")
    return fold_rows(items, keys, [order, size], [amount], run, "admitted boolean, used bigint")
