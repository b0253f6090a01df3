"""Portfolio scores: initiatives (costs, benefits, risks), data products, taxonomy and metadata quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Discount rate, weights and floors.
DISCOUNT = 0.10
GROWTH = 0.05
INITIATIVE_WEIGHTS = {"financial": 0.35, "strategic": 0.25, "operational": 0.20, "risk_adjusted": 0.20}
INITIATIVE_CATEGORIES = (("transformational", 85), ("high", 70), ("medium", 50), ("low", 30))
RISK_WEIGHTS = {"technical": 0.30, "organizational": 0.25, "external": 0.20, "ai_specific": 0.25}
RISK_LEVELS = (("critical", 75), ("high", 60), ("medium", 40), ("low", 20))
PRODUCT_WEIGHTS = {"purpose": 0.15, "consumers": 0.10, "contract": 0.20, "quality": 0.20, "governance": 0.15, "delivery": 0.10, "value": 0.10}


def ladder(score: Column, steps, rest: str) -> Column:
    out = F.when(score >= steps[0][1], steps[0][0])
    for name, floor in steps[1:]:
        out = out.when(score >= floor, name)
    return out.otherwise(rest)


def npv(investment: Column, benefit: Column, cost: Column, years: int = 3, rate: float = DISCOUNT, growth: float = GROWTH) -> Column:
    """Net present value of a benefit that grows each year against a level cost."""
    flows = F.transform(F.sequence(F.lit(1), F.lit(years)), lambda t: (benefit * F.pow(F.lit(1 + growth), t - 1) - cost) / F.pow(F.lit(1 + rate), t))
    return F.aggregate(flows, -investment.cast("double"), lambda a, x: a + x)


def roi(investment: Column, benefit: Column) -> Column:
    return F.when(investment == 0, 0.0).otherwise((benefit - investment) / investment * 100)


def payback_months(investment: Column, benefit: Column, cost: Column) -> Column:
    """Whole months until the investment is back; 999 for never, 120 at most."""
    return F.when(benefit <= cost, 999).otherwise(F.least(F.lit(120), F.floor(investment / (benefit - cost) * 12).cast("int")))


@F.pandas_udf(T.DoubleType())
def irr(flows: pd.Series) -> pd.Series:
    """Internal rate of return in percent by Newton's method from 0.1, all rows of a batch at once."""
    if not len(flows):
        return pd.Series([], dtype=float)
    size = max((len(f) for f in flows if f is not None), default=1)
    cash = np.array([np.pad(np.asarray(f, float), (0, size - len(f))) if f is not None else np.zeros(size) for f in flows])
    t = np.arange(size)
    rate, busy = np.full(len(cash), 0.1), np.ones(len(cash), bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            base = (1 + rate)[:, None]
            value, slope = (cash / base**t).sum(1), (-t * cash / base ** (t + 1)).sum(1)
            busy &= np.abs(slope) >= 1e-10
            new = np.where(busy, rate - value / slope, rate)
            moved = np.abs(new - rate) >= 1e-6
            rate = new
            busy &= moved
            if not busy.any():
                break
    return pd.Series(rate * 100)


def risk_scores(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean of each risk group, the weighted overall score and its level."""
    out = df
    for g, cols in groups.items():
        out = out.withColumn(f"{g}_risk", sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols))
    overall = sum((F.col(f"{g}_risk") * w for g, w in RISK_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall_risk", overall).withColumn("risk_level", ladder(F.col("overall_risk"), RISK_LEVELS, "minimal"))


def recommendation(score: Column, roi_: Column, risk: Column) -> Column:
    return (
        F.when((score >= 85) & (roi_ > 100) & risk.isin("low", "minimal"), "INVEST - High priority strategic initiative").when((score >= 70) & (roi_ > 50), "INVEST - Strong business case")
        .when((score >= 50) & (roi_ > 0), "CONSIDER - Moderate value, review priorities").when(score >= 30, "DEFER - Limited value, consider alternatives").otherwise("DECLINE - Insufficient business case")
    )


def initiative_scores(df: DataFrame) -> DataFrame:
    """Overall score of financial, strategic, operational and risk_adjusted, with category and recommendation (needs roi, risk_level)."""
    overall = sum((F.col(k) * w for k, w in INITIATIVE_WEIGHTS.items()), F.lit(0.0))
    out = df.withColumn("overall", overall)
    return out.withColumn("category", ladder(F.col("overall"), INITIATIVE_CATEGORIES, "experimental")).withColumn("recommendation", recommendation(F.col("overall"), F.col("roi"), F.col("risk_level")))


def portfolio_report(df: DataFrame) -> DataFrame:
    """Totals, return, quick wins (60 and more, below the mean investment, back within 18 months) and high-risk initiatives."""
    mean = df.agg(F.avg("investment").alias("mean_investment"))
    quick = (F.col("overall") >= 60) & (F.col("investment") < F.col("mean_investment")) & (F.col("payback") <= 18)
    out = df.join(F.broadcast(mean)).agg(
        F.count(F.lit(1)).alias("initiatives"), F.sum("investment").alias("investment"), F.sum("benefit").alias("benefit"), F.avg("overall").alias("mean_score"),
        F.count_if(quick).alias("quick_wins"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk"),
    )
    return out.withColumn("roi", roi(F.col("investment"), F.col("benefit")))


def truthy(*cols: Column) -> Column:
    """Percent of the given conditions that hold."""
    return sum((c.cast("int") for c in cols), F.lit(0)) / len(cols) * 100


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string") != "", F.lit(False))


def data_product_scores(df: DataFrame) -> DataFrame:
    """Scores of products (purpose, outcomes, n_consumers, contract and governance fields, format, channel, quality 0..1, value 0..100)."""
    n = F.coalesce(F.col("n_consumers"), F.lit(0))
    parts = {
        "purpose": truthy(filled("purpose"), filled("outcomes")),
        "consumers": F.when(n == 0, 0.0).when(n == 1, 60.0).when(n <= 3, 80.0).otherwise(100.0),
        "contract": truthy(*[filled(c) for c in ("schema_text", "granularity", "sla_hours", "freshness_hours", "semantics", "rules", "version")]),
        "quality": F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("quality"), F.lit(0.0)) * 100)),
        "governance": truthy(*[filled(c) for c in ("owner", "steward", "classification", "lineage", "access")], F.col("pii").isNotNull(), filled("retention")),
        "delivery": truthy(filled("format"), filled("channel")),
        "value": F.coalesce(F.col("value"), F.lit(0.0)),
    }
    scored = df.select("product", *[c.alias(f"{k}_score") for k, c in parts.items()])
    overall = sum((F.col(f"{k}_score") * w for k, w in PRODUCT_WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("overall", overall).withColumn("status", ladder(F.col("overall"), (("excellent", 80), ("good", 60), ("fair", 40)), "poor"))


def metadata_scores(df: DataFrame, clarity: DataFrame | None = None) -> DataFrame:
    """Metadata quality of tables (name, description, owner, tags, classification, documented and all columns): 0.30, 0.10, 0.10, 0.10, 0.40.

    A description that is blank, under ten characters or the name again is absent; others are as clear as their label says, poor without one.
    """
    plain = F.lower(F.regexp_replace("description", r"[_\s]", "")) == F.lower(F.regexp_replace("name", r"[_\s]", ""))
    absent = F.col("description").isNull() | (F.length(F.trim("description")) < 10) | plain
    out = df.join(clarity, "name", "left") if clarity is not None else df.withColumn("label", F.lit(None).cast("string"))
    clear = F.when(F.coalesce(absent, F.lit(True)), 0.0).when(F.col("label") == "good", 1.0).when(F.col("label") == "fair", 0.6).otherwise(0.3)
    columns = F.when(F.col("columns") > 0, F.col("documented") / F.col("columns")).otherwise(F.lit(0.0))
    score = 0.30 * clear + 0.10 * filled("owner").cast("int") + 0.10 * (F.col("tags") > 0).cast("int") + 0.10 * filled("classification").cast("int") + 0.40 * columns
    return out.select("name", score.alias("score")).withColumn("status", F.when(F.col("score") < 0.3, "poor").when(F.col("score") < 0.7, "partial").otherwise("good"))


def irr_of(df: DataFrame, investment: str, benefit: str, cost: str, years: int = 3) -> DataFrame:
    flows = F.concat(F.array(-F.col(investment).cast("double")), F.transform(F.sequence(F.lit(1), F.lit(years)), lambda t: F.col(benefit) * F.pow(F.lit(1 + GROWTH), t - 1) - F.col(cost)))
    return df.withColumn("irr", irr(flows))




def score_parts(df: DataFrame) -> DataFrame:
    """Adds financial, strategic, operational and risk_adjusted scores, 0 to 100.

    Financial: return over 200 percent, months until payback in steps of twelve, and present value over investment, .4, .3, .3. Strategic: base, alignment,
    sponsorship, timing, .3, .3, .2, .2. Operational: hours gained, customers, less risk, readiness, .3, .25, .2, .25. The adjusted score is the mean of
    the three times a factor of the overall risk, and .02 for each measure taken, .1 at most. Without an investment the present value counts 50.
    """
    c = F.col
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    months = c("payback")
    paid = F.when(months <= 12, 100.0).when(months <= 24, 80.0).when(months <= 36, 60.0).when(months <= 48, 40.0).otherwise(F.greatest(F.lit(0.0), 40 - (months - 48) / 2))
    present = F.when(c("investment") == 0, 50.0).otherwise(clip(50 + c("npv") / c("investment") * 50))
    financial = clip(c("roi") / 200 * 100) * 0.4 + paid * 0.3 + present * 0.3
    strategic = c("strategic_base") * 0.30 + c("alignment") * 0.30 + c("sponsorship") * 0.20 + c("timing") * 0.20
    ready = c("implementation") * 0.4 + c("team") * 0.3 + c("infrastructure") * 0.3
    operational = F.least(F.lit(100.0), F.greatest(F.lit(0.0), c("hours") / 100)) * 0.30 + clip(c("satisfaction") * 2 + c("retained") * 3) * 0.25 + (c("less_compliance_risk") + c("less_operational_risk")) / 2 * 0.20 + ready * 0.25
    cents = lambda x: F.round(x + 1e-9, 2)  # noqa: E731  (a half goes up, whatever its last bit)
    out = df.withColumns({"financial": cents(financial), "strategic": cents(strategic), "operational": cents(operational)})
    risk = c("overall_risk")
    factor = F.when(risk < 20, 1.1).when(risk < 40, 1.0).when(risk < 60, 0.85).when(risk < 80, 0.70).otherwise(0.50) + F.least(F.lit(0.1), c("mitigations") * 0.02)
    return out.withColumn("risk_adjusted", cents(clip((c("financial") + c("strategic") + c("operational")) / 3 * factor)))
