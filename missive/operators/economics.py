"""Decision economics: costs, break-even, and allocation under a risk budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.operators.ranges import before

# Default costs per message and the budgets of the risk curve.
RISK_BUDGETS = [0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20]


@dataclass(frozen=True)
class Costs:
    marketing: float = 7.5
    utility: float = 1.0
    rework: float = 2.0
    penalty: float = 40.0

    @property
    def reclassified(self) -> float:
        return self.marketing + self.rework + self.penalty

    @property
    def break_even(self) -> float:
        """Least utility probability at which declaring UTILITY pays."""
        spread = self.reclassified - self.utility
        return 0.0 if spread <= 0 else max(0.0, min(1.0, (self.reclassified - self.marketing) / spread))

    def if_utility(self, p: Column) -> Column:
        return p * self.utility + (1 - p) * self.reclassified


def money(c: Column) -> Column:
    """Four decimals: exact for prices of one decimal and probabilities of three."""
    return F.round(c, 4)


def costs(df: DataFrame, model: Costs = Costs(), p: str = "p_utility") -> DataFrame:
    pure = Costs(model.marketing, model.utility, 0.0, 0.0)
    return df.withColumns({
        "cost_if_utility": money(model.if_utility(F.col(p))), "cost_if_marketing": F.lit(model.marketing), "break_even": F.round(F.lit(model.break_even), 3),
        "saving": F.lit(model.marketing - model.utility), "pure_break_even": F.round(F.lit(pure.break_even), 3)})


def decide(df: DataFrame, model: Costs = Costs(), p: str = "p_utility") -> DataFrame:
    return df.withColumn("declare", F.when(F.col(p) >= model.break_even, "UTILITY").otherwise("MARKETING"))


def weights(df: DataFrame) -> DataFrame:
    """volume: 1 for all unless any is given, then 0 where it is missing."""
    given = df.agg(F.coalesce(F.bool_or(F.col("monthly_volume").isNotNull()), F.lit(False)).alias("__given"))
    volume = F.when(F.col("__given"), F.coalesce("monthly_volume", F.lit(0.0))).otherwise(1.0)
    return df.crossJoin(F.broadcast(given)).withColumn("volume", volume).drop("__given")


def running_totals(df: DataFrame) -> DataFrame:
    """cum_volume, cum_risk over (p_utility desc, volume desc, id), in two levels.

    Rows are totalled by probability and volume first; the running sum over those groups
    gives each its offset, and only rows of one group are ordered together.
    """
    risk = F.round(F.col("volume") * (1 - F.col("p_utility")), 9)
    groups = df.groupBy("p_utility").agg(F.sum("volume").alias("v"), F.sum(risk).alias("r"))
    offsets = before(groups, "p_utility", ["v", "r"], descending=True).select("p_utility", F.col("before_v").alias("v0"), F.col("before_r").alias("r0"))
    inside = Window.partitionBy("p_utility").orderBy(F.desc("volume"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.join(offsets, "p_utility")
    return out.withColumns({"cum_volume": F.round(F.col("v0") + F.sum("volume").over(inside), 6), "cum_risk": F.round(F.col("r0") + F.sum(risk).over(inside), 6)}).drop("v0", "r0")


def within(budget: Column) -> Column:
    """Is the prefix up to this row within budget? Along the order the ratio never falls."""
    return (F.col("cum_volume") > 0) & (F.round(F.col("cum_risk") / F.nullif("cum_volume", F.lit(0.0)), 9) <= budget)


def allocate(df: DataFrame, budget: float = 0.05, model: Costs = Costs()) -> DataFrame:
    """declare: UTILITY for the longest prefix within the risk budget."""
    rows = running_totals(weights(df))
    first_bad = rows.where(~within(F.lit(budget))).agg(F.min(F.struct((-F.col("p_utility")).alias("p"), (-F.col("volume")).alias("v"), "id")).alias("stop"))
    ahead = F.col("stop").isNull() | (F.struct((-F.col("p_utility")).alias("p"), (-F.col("volume")).alias("v"), "id") < F.col("stop"))
    out = rows.crossJoin(F.broadcast(first_bad)).withColumn("declare", F.when(ahead, "UTILITY").otherwise("MARKETING")).drop("stop")
    return out.withColumn("saving", F.when(F.col("declare") == "UTILITY", money(F.col("volume") * F.col("p_utility") * (model.marketing - model.utility))).otherwise(0.0))


def portfolio(plans: DataFrame, model: Costs = Costs()) -> DataFrame:
    chosen = F.col("declare") == "UTILITY"
    volume, risk = F.sum(F.when(chosen, F.col("volume"))), F.sum(F.when(chosen, F.round(F.col("volume") * (1 - F.col("p_utility")), 9)))
    total = F.sum("volume")
    return plans.agg(
        F.count_if(chosen).alias("declared_utility"), F.count(F.lit(1)).alias("templates"), F.round(F.coalesce(volume, F.lit(0.0)), 2).alias("utility_volume"), F.round(total, 2).alias("total_volume"),
        F.round(F.coalesce(F.try_divide(volume, total), F.lit(0.0)), 4).alias("utility_share"), F.round(F.coalesce(F.try_divide(risk, volume), F.lit(0.0)), 4).alias("misclassification"),
        F.round(total * model.marketing, 2).alias("baseline"), F.round(total * model.marketing - F.coalesce(volume, F.lit(0.0)) * (model.marketing - model.utility), 2).alias("projected"))


def risk_curve(df: DataFrame, budgets: list[float] = RISK_BUDGETS) -> DataFrame:
    """budget, declared_utility, utility_volume: every budget from one pass of running totals."""
    rows = running_totals(weights(df)).withColumn("ratio", F.round(F.try_divide("cum_risk", "cum_volume"), 9))
    limits = df.sparkSession.createDataFrame([(b,) for b in budgets], "budget double")
    fits = F.coalesce(F.col("ratio") <= F.col("budget"), F.lit(False))
    return rows.crossJoin(F.broadcast(limits)).groupBy("budget").agg(F.count_if(fits).alias("declared_utility"), F.round(F.coalesce(F.max(F.when(fits, F.col("cum_volume"))), F.lit(0.0)), 2).alias("utility_volume"))
