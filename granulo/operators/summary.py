"""Figures for each data set, and pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.functions import geometry as G

from .quantiles import quantiles

TENTHS = {"particle_D10": ("D", 0.1), "particle_D50": ("D", 0.5), "particle_D90": ("D", 0.9)}
COUNTS = ["N_primary_particle", "N_aerosol_particle", "N_pp1", "N_ppA", "N_agl", "N_collector_agl", "N_similar_agl", "N_pp1_separate"]


def _particles() -> list:
    return [F.count("*").alias("N_primary_particle"), F.avg("D").alias("particle_Dmean"), F.stddev_samp("D").alias("particle_Dstd"), G.ratio(F.sum(F.pow("D", F.lit(3.0))), F.sum(F.pow("D", F.lit(2.0)))).alias("particle_SMD")]


def _aggl() -> list:
    one = F.count_if(F.col("members_count") == 1)
    kind = lambda t: F.count_if(F.col("type") == t)
    return [F.count("*").alias("N_aerosol_particle"), one.alias("N_pp1"), kind("collector").alias("N_collector_agl"), kind("similar").alias("N_similar_agl"), kind("separate").alias("N_pp1_separate"), F.avg("members_count").alias("agl_member_count_mean"), F.stddev_samp("members_count").alias("agl_member_count_std")]


def _ratios(d: DataFrame, pooled: bool) -> DataFrame:
    c = F.col
    d = d.withColumn("N_ppA", c("N_primary_particle") - c("N_pp1")).withColumn("N_agl", c("N_aerosol_particle") - c("N_pp1"))
    grouped = c("N_agl") if pooled else c("N_collector_agl") + c("N_similar_agl")
    return d.withColumns({
        "ER": 1 - G.ratio(c("N_pp1_separate"), c("N_primary_particle")), "Ra": G.ratio(c("N_agl"), c("N_primary_particle")), "sep2agl": G.ratio(c("N_pp1_separate"), grouped),
        "n_ppA_mean": G.ratio(c("N_ppA"), c("N_agl")), "n_ppP_mean": G.ratio(c("N_primary_particle"), c("N_aerosol_particle")),
    })


DS_COLUMNS = ["ds_id", *COUNTS, "ER", "Ra", "sep2agl", "n_ppA_mean", "n_ppP_mean", "particle_Dmean", "particle_Dstd", "particle_D10", "particle_D50", "particle_D90", "particle_SMD", "agl_member_count_mean", "agl_member_count_std"]


def dataset_summary(parts: DataFrame, aggl: DataFrame) -> DataFrame:
    """DS_COLUMNS, a row for each data set. Figures without a denominator are null. (Names differ from N_ppA and N_ppP by more than case, as SQL takes no notice of case.)"""
    j = parts.groupBy("ds_id").agg(*_particles()).join(aggl.groupBy("ds_id").agg(*_aggl()), "ds_id").join(quantiles(parts, ["ds_id"], TENTHS), "ds_id", "left")
    return _ratios(j, pooled=False).select(*DS_COLUMNS)


POOLED = [*DS_COLUMNS[1:], "agl_Dmean", "agl_Dstd", "agl_D10", "agl_D50", "agl_D90", "agl_member_count_q10", "agl_member_count_q50", "agl_member_count_q90"]


def pooled_summary(parts: DataFrame, aggl: DataFrame) -> DataFrame:
    """(metric, value) over all data sets: counts are sums, ratios come from sums, and statistics from pooled rows."""
    more = [F.avg("D").alias("agl_Dmean"), F.stddev_samp("D").alias("agl_Dstd")]
    ends = {"10": 0.1, "50": 0.5, "90": 0.9}
    of_aggl = {f"agl_D{k}": ("D", p) for k, p in ends.items()} | {f"agl_member_count_q{k}": ("members_count", p) for k, p in ends.items()}
    # All quantiles at once, of columns that are null in the other table's rows.
    of = {f"of_particle_{c}": F.col(c).cast("double") for c, _ in TENTHS.values()}, {f"of_aggl_{c}": F.col(c).cast("double") for c, _ in of_aggl.values()}
    both = [t.select(*[v.alias(c) for c, v in o.items()]) for t, o in zip((parts, aggl), of, strict=True)]
    asked = {name: (f"of_particle_{c}", p) for name, (c, p) in TENTHS.items()} | {name: (f"of_aggl_{c}", p) for name, (c, p) in of_aggl.items()}
    ranked = quantiles(both[0].unionByName(both[1], allowMissingColumns=True), [], asked)
    one = parts.agg(*_particles()).crossJoin(aggl.agg(*_aggl(), *more)).crossJoin(ranked)  # one row each
    one = _ratios(one, pooled=True)
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in POOLED])))
