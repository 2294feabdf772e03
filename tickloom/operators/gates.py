"""Pass / fail decisions over metric tables, as columns."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def sample_ok(count: Column, least: int) -> Column:
    return _yes(count >= least)


def edge_ok(net_exp: Column, net_pf: Column, sharpe: Column, pf: float = 1.0) -> Column:
    return _yes((net_exp > 0) & (net_pf > pf) & (sharpe > 0))


def screening(count: Column, net_exp: Column, net_pf: Column, sharpe: Column, consistent: Column) -> Column:
    return (F.when(~sample_ok(count, 30), "INSUFFICIENT SAMPLE")
            .when(~edge_ok(net_exp, net_pf, sharpe), "FAIL (edge/PF/Sharpe not positive under BASE)")
            .when(_yes(consistent), "PASS SCREENING")
            .otherwise("PASS BUT INCONSISTENT"))


def sign_conflict(best: Column, worst: Column, band: float = 0.01) -> Column:
    """One asset clearly positive while another is clearly negative."""
    return _yes((best > band) & (worst < -band))


def development_cost_class(gross_exp: Column, base_exp: Column, base_pf: Column, stress_exp: Column,
                           stress_pf: Column) -> Column:
    return (F.when(gross_exp <= 0, "NO EDGE")
            .when(~_yes((base_exp > 0) & (base_pf > 1)), "EDGE TOO THIN")
            .when(~_yes((stress_exp > 0) & (stress_pf > 1)), "COST SENSITIVE")
            .otherwise("COST ROBUST IN DEVELOPMENT"))


def development_survival(net_exp, net_pf, sharpe, positive_buckets, conflict, count, least_buckets=4) -> Column:
    return edge_ok(net_exp, net_pf, sharpe) & _yes(positive_buckets >= least_buckets) & ~_yes(conflict) & \
        sample_ok(count, 100)


def stress_ok(exp: Column, pf: Column) -> Column:
    return _yes((exp >= 0) & (pf >= 1.0))


def timeframe_verdict(net_exp, net_pf, sharpe, stress_exp, stress_pf, positive_buckets, all_assets_positive,
                      conflict, count, least_buckets=4) -> Column:
    gate = (edge_ok(net_exp, net_pf, sharpe, 1.05) & stress_ok(stress_exp, stress_pf)
            & _yes(positive_buckets >= least_buckets) & _yes(all_assets_positive) & ~_yes(conflict)
            & sample_ok(count, 100))
    return F.when(gate, "PASS").when(_yes((net_exp > 0) & (net_pf > 1.05)), "PARTIAL").otherwise("FAIL")


def asset_gate(net_exp: Column, net_pf: Column, sharpe: Column) -> Column:
    return edge_ok(net_exp, net_pf, sharpe, 1.05)


def external_gates(assets: DataFrame, years: DataFrame, keys: list[str]) -> DataFrame:
    """Per key over its assets: base and stress gates, year share, sample size.

    ``assets``: base_net_exp, base_net_pf, base_sharpe, stress_net_exp, stress_net_pf, count.
    ``years``: one row per asset and year with net_exp.
    """
    c = F.col
    a = assets.groupBy(*keys).agg(
        F.bool_and(asset_gate(c("base_net_exp"), c("base_net_pf"), c("base_sharpe"))).alias("asset_pass"),
        F.bool_and(stress_ok(c("stress_net_exp"), c("stress_net_pf"))).alias("stress_pass"),
        F.bool_and(c("count") >= 100).alias("sample_pass"))
    y = years.groupBy(*keys).agg(year_share().alias("year_share"))
    out = a.join(y, keys, "left")
    return out.withColumn("year_pass", _yes(c("year_share") >= 0.6)).withColumn(
        "verdict", F.when(c("asset_pass") & c("stress_pass") & c("sample_pass") & c("year_pass"), "PASS")
        .otherwise("FAIL"))


def year_share(exp: str = "net_exp") -> Column:
    """Share of buckets with positive expectancy, as an aggregate."""
    return F.count_if(F.col(exp) > 0) / F.count(F.lit(1))


def regime_check(exp: str = "net_exp", year: int = 2025) -> Column:
    """All assets negative in one year is systematic; as an aggregate over that year's rows."""
    v = F.col(exp)
    return (F.when(F.count(v) == 0, "INSUFFICIENT DATA")
            .when(F.bool_and(v < 0), f"SYSTEMATIC {year} REGIME FAILURE").otherwise("mixed (not systematic)"))


def cost_class(gross_exp, base_exp, base_pf, stress_exp, stress_pf) -> Column:
    return (F.when(~_yes(gross_exp > 0), "NO EDGE")
            .when(~_yes((base_exp > 0) & (base_pf > 1)), "EDGE FAILS REALISTIC COST")
            .when(stress_ok(stress_exp, stress_pf), "COST ROBUST").otherwise("COST SENSITIVE"))


def grade(count, gross_exp, gross_return, base_exp, base_return) -> Column:
    return (F.when(count < 30, "A").when(gross_exp.isNull() | (gross_exp <= 0) | (gross_return <= 0), "B")
            .when((base_exp <= 0) | (base_return <= 0), "C").otherwise("D"))


# Wording of the grades.
GRADE_LABELS = {
    "A": "INSUFFICIENT DATA",
    "B": "NEGATIVE EXPECTANCY IN TEST DATA",
    "C": "POSITIVE GROSS EXPECTANCY BUT FAILS COST TEST",
    "D": "POSITIVE EXPECTANCY UNDER TESTED ASSUMPTIONS",
}


def grade_label(g: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GRADE_LABELS.items() for x in kv])[g]


def edge_destroyed(before: Column, after: Column) -> Column:
    return _yes((before > 0) & (after <= 0))


def carry_verdict(base_all: Column, stress_all: Column, years: Column, destroyed: Column) -> Column:
    return F.when(base_all & stress_all & years & ~destroyed, "SURVIVED").otherwise("FAILED")


def carry_gates(assets: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Per key over its assets: gates with carry, share of positive periods, edge kept, verdict.

    ``assets``: before_exp (without carry), net_exp_pct, net_profit_factor, sharpe, stress_exp, stress_pf; an asset
    without them (no trades) fails both gates and destroys no edge. ``periods``: net_exp of each asset and full period;
    a key without any fails the share.
    """
    c = F.col
    a = assets.groupBy(*keys).agg(
        F.bool_and(asset_gate(c("net_exp_pct"), c("net_profit_factor"), c("sharpe"))).alias("base_pass"),
        F.bool_and(stress_ok(c("stress_exp"), c("stress_pf"))).alias("stress_pass"),
        F.bool_or(edge_destroyed(c("before_exp"), c("net_exp_pct"))).alias("edge_destroyed"))
    out = a.join(periods.groupBy(*keys).agg(year_share().alias("year_share")), keys, "left")
    out = out.withColumn("year_pass", _yes(c("year_share") >= 0.6))
    return out.withColumn("verdict", carry_verdict(c("base_pass"), c("stress_pass"), c("year_pass"), c("edge_destroyed")))


def same_sign(value: str) -> Column:
    """All rows below 0 or all above 0, as an aggregate."""
    return F.bool_and(F.col(value) < 0) | F.bool_and(F.col(value) > 0)


def pooled_final(total: Column, exp, pf, sharpe, assets_ok: Column, stress_exp, stress_pf) -> Column:
    """Pooled gates: fewer than 50 trades decide nothing; three of four assets must hold."""
    gate = edge_ok(exp, pf, sharpe, 1.05) & _yes(assets_ok >= 3) & stress_ok(stress_exp, stress_pf)
    return F.when(total < 50, "INCONCLUSIVE").when(gate, "PASS").otherwise("FAIL")


def best_by(dimension: DataFrame, keys: list[str], name: str, value: str, highest: bool = True) -> Column:
    """Name of the best row as an aggregate; NULL values never win."""
    v = F.when(F.col(value).isNotNull(), F.col(value))
    return (F.max_by if highest else F.min_by)(name, v)


def best_candidate(passed: DataFrame, order: list[str]) -> DataFrame:
    """The one row that is highest in ``order`` (later columns break ties)."""
    return passed.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(1)
