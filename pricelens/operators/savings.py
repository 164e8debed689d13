"""Savings model (F14, F15) and good-price averages.

The savings model is arithmetic over a scenario table (one row per budget x
precision x price assumptions), so it runs as column expressions; every
integer step truncates like the reference's ``int()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_COLS, Cols
from .labels import with_good_price

# The reference's default prices and market share of good deals.
DEFAULT_AVG_ALL = 92.84
DEFAULT_AVG_GOOD = 63.04
DEFAULT_AVG_NOT_GOOD = 100.70
GOOD_SHARE = 0.2


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _trunc(x: Column) -> Column:
    return x.cast("bigint")


def good_price_averages(df: DataFrame, cols: Cols = DEFAULT_COLS) -> DataFrame:
    """Mean price of all, good (W23 label) and not-good rows; constants when undefined."""
    g = with_good_price(df, cols)
    p = F.col(cols.price)
    return g.agg(
        F.coalesce(F.avg(p), F.lit(DEFAULT_AVG_ALL)).alias("avg_all_price"),
        F.coalesce(F.avg(F.when(F.col("good_price") == 1, p)), F.lit(DEFAULT_AVG_GOOD)).alias("avg_good_price"),
        F.coalesce(F.avg(F.when(F.col("good_price") == 0, p)), F.lit(DEFAULT_AVG_NOT_GOOD)).alias("avg_not_good_price"),
        F.avg(F.col("good_price").cast("double")).alias("good_share"))


def savings(df: DataFrame, budget="budget", precision="precision", avg_good="avg_good_price",
            avg_not_good="avg_not_good_price", avg_all="avg_all_price", variant: str = "script") -> DataFrame:
    """Add the ticket-purchase comparison columns to a scenario table.

    ``variant='script'`` (F14): random choice pays the overall average for
    tickets, good ones at the good price; ``variant='dashboard'`` (F15):
    random choice pays the not-good price, plus cost per ticket and
    model-minus-random differences; zero or missing prices fall back to the
    default constants.
    """
    b, pr = _c(budget).cast("double"), _c(precision).cast("double")
    good, bad, allp = _c(avg_good).cast("double"), _c(avg_not_good).cast("double"), _c(avg_all).cast("double")
    if variant == "script":
        n_r = _trunc(b / allp)
        n_rg = _trunc(n_r * F.lit(GOOD_SHARE))
        pred = pr * good + (F.lit(1.0) - pr) * bad
        n_m = _trunc(b / pred)
        n_mg = _trunc(n_m * pr)
        return df.select(
            "*",
            n_r.alias("random_tickets"), n_rg.alias("random_good"), (n_r - n_rg).alias("random_bad"),
            (n_rg * good + (n_r - n_rg) * bad).alias("random_cost"),
            pred.alias("avg_pred_good"),
            n_m.alias("model_tickets"), n_mg.alias("model_good"), (n_m - n_mg).alias("model_bad"),
            (n_mg * good + (n_m - n_mg) * bad).alias("model_cost"))
    if variant != "dashboard":
        raise ValueError(f"unknown variant {variant!r}")
    use_default = good.isNull() | bad.isNull() | (good == 0) | (bad == 0)
    good = F.when(use_default, F.lit(DEFAULT_AVG_GOOD)).otherwise(good)
    bad = F.when(use_default, F.lit(DEFAULT_AVG_NOT_GOOD)).otherwise(bad)
    pred = good * pr + bad * (F.lit(1.0) - pr)
    n_r = _trunc(b / bad)
    n_m = _trunc(b / pred)
    r_cost, m_cost = n_r * bad, n_m * pred
    r_cpt = F.when(n_r > 0, r_cost / n_r).otherwise(F.lit(0.0))
    m_cpt = F.when(n_m > 0, m_cost / n_m).otherwise(F.lit(0.0))
    out = df.select("*", n_r.alias("random_tickets"), _trunc(n_r * F.lit(GOOD_SHARE)).alias("random_good"),
                    r_cost.alias("random_cost"), r_cpt.alias("random_cost_per_ticket"),
                    n_m.alias("model_tickets"), _trunc(n_m * pr).alias("model_good"),
                    m_cost.alias("model_cost"), m_cpt.alias("model_cost_per_ticket"))
    return out.select("*", (F.col("model_tickets") - F.col("random_tickets")).alias("tickets_diff"),
                      (F.col("model_good") - F.col("random_good")).alias("good_deals_diff"),
                      (F.col("model_cost") - F.col("random_cost")).alias("cost_diff"),
                      (F.col("model_cost_per_ticket") - F.col("random_cost_per_ticket")).alias("cost_per_ticket_diff"))
