"""

The driver's tables hold no circles, so `part` stands in: a brand is a data set, a part a particle, and whole-number
arithmetic that every engine evaluates alike gives it a place.
"""

from __future__ import annotations

import importlib
import logging
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulo.functions import geometry, units, values
from granulo.operators import clusters, components, drawing, histogram, morphology, overlap, particles, summary, touching
from granulo.sources import legacy, particle_csv

log = logging.getLogger("granulo")

MODULI = (401, 409)
NEAR = (200.0, 200.0, 30.0, 60.0)
LINEAR = histogram.bin_edges(0, 60, 12)
STEPPED = histogram.bin_edges(0, 50, 8, step=True)
LOGGED = histogram.bin_edges(1, 100, 10, log=True)
COUNTED = [float(x) for x in range(0, 16, 2)]


def _optional() -> list:
    """Modules that add queries, where they can be imported. What stops one that is there is said on the log."""
    out = []
    for name in ("granulo.llm.registry", "corpus_pipeline"):
        try:
            out.append(importlib.import_module(name))
        except ImportError as e:
            (log.info if isinstance(e, ModuleNotFoundError) and e.name and name.startswith(e.name) else log.warning)("queries of %s are left out: %s", name, e)
    return out


# ---- circles from part ------------------------------------------------------------------------


def circles(spark: SparkSession, sf_dir: str, moduli: tuple[int, int] = MODULI) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    at = lambda f, m: ((F.col("p_partkey") * f) % m).cast("double")
    return p.select(F.col("p_brand").alias("ds_id"), F.col("p_partkey").alias("ID"), at(7919, moduli[0]).alias("X"), at(10473, moduli[1]).alias("Y"), F.col("p_size").cast("double").alias("D"))


class Circles:
    """The steps up to classified particles. Pairs, nodes and members are kept, as a query reads them several times. Only what is
    asked for pairs lists them. Without inside nobody looks for contained circles, and members have no idj."""

    def __init__(self, spark: SparkSession, sf_dir: str, moduli: tuple[int, int] = MODULI, inside: bool = True):
        self.parts = particles.particles(circles(spark, sf_dir, moduli))
        self.inside = inside

    @cached_property
    def pairs(self) -> DataFrame:
        return overlap.overlap_pairs(self.parts).cache()

    @cached_property
    def nodes(self) -> DataFrame:
        return touching.nodes(self.parts.cache(), self.inside).cache()

    def labels(self, method: str = "auto") -> DataFrame:
        return clusters.components(self.parts, touching.links(self.nodes), method)

    def once(self) -> DataFrame:
        """Members that are read once, and so aren't kept: only columns that are asked for are made."""
        parts = touching.flag_contained(self.parts, self.nodes) if self.inside else self.parts
        return morphology.membership(parts, self.labels())

    def members(self) -> DataFrame:
        return self.once().cache()

    def aggl(self) -> DataFrame:
        return morphology.agglomerates(self.members()).cache()

    def aggl_once(self) -> DataFrame:
        """As once(): what isn't asked for, such as centres of mass, isn't made."""
        return morphology.agglomerates(self.once())


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, as sums depend on order."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema if not names or f.name in names])


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


_DIST = "sqrt((a.X - b.X) * (a.X - b.X) + (a.Y - b.Y) * (a.Y - b.Y))"
_P = f"""p AS (SELECT p_brand AS ds_id, p_partkey AS ID, ((p_partkey * 7919) % {MODULI[0]})::DOUBLE AS X, ((p_partkey * 10473) % {MODULI[1]})::DOUBLE AS Y,
  p_size::DOUBLE AS D, pi() * pow(p_size / 2.0, 2) AS area, 4.0 / 3 * pi() * pow(p_size / 2.0, 3) AS volume FROM part)"""
_E = f"""e AS (SELECT a.ds_id, a.ID AS a, b.ID AS b, a.D AS Da, b.D AS Db, {_DIST} AS dist FROM p a JOIN p b ON a.ds_id = b.ds_id AND a.ID <> b.ID AND {_DIST} <= (a.D + b.D) / 2)"""
_R = """r(ds_id, ID, root) AS (SELECT ds_id, ID, ID FROM p UNION SELECT r.ds_id, e.b, r.root FROM r JOIN e ON r.ds_id = e.ds_id AND r.ID = e.a),
c AS (SELECT ds_id, ID, min(root) AS agl FROM r GROUP BY ds_id, ID),
m AS (SELECT p.*, c.agl, row_number() OVER (PARTITION BY p.ds_id, c.agl ORDER BY p.D DESC, p.ID) AS k,
  EXISTS (SELECT 1 FROM e WHERE e.ds_id = p.ds_id AND e.b = p.ID AND e.dist <= (e.Da - e.Db) / 2) AS idj FROM p JOIN c ON p.ds_id = c.ds_id AND p.ID = c.ID),
com AS (SELECT ds_id, agl, sum(area * X) / sum(area) AS X_com, sum(area * Y) / sum(area) AS Y_com FROM m GROUP BY ds_id, agl),
g AS (SELECT m.ds_id, m.agl, sum(volume) AS volume, sum(volume) + sum(CASE WHEN idj THEN volume ELSE 0 END) AS volume_dsom, any_value(X_com) AS X_com, any_value(Y_com) AS Y_com,
  sqrt(sum(area * ((X - X_com) * (X - X_com) + (Y - Y_com) * (Y - Y_com))) / sum(area)) AS Rg, count(*) AS members_count, count(*) FILTER (WHERE idj) AS idj_members_count,
  avg(D) AS members_Dmean, stddev_samp(D) AS members_Dstdev, max(CASE WHEN k = 1 THEN D END) AS D1, max(CASE WHEN k = 2 THEN D END) AS D2, max(CASE WHEN k = 1 THEN ID END) AS seed
  FROM m JOIN com ON m.ds_id = com.ds_id AND m.agl = com.agl GROUP BY m.ds_id, m.agl),
a AS (SELECT *, pow(6 * volume / pi(), 1.0 / 3) AS D, pow(6 * volume_dsom / pi(), 1.0 / 3) AS D_dsom, 2 * Rg AS Dg, members_count + idj_members_count AS members_count_dsom,
  CASE WHEN members_count = 1 THEN 'separate' WHEN D2 / D1 <= 0.5 THEN 'collector' ELSE 'similar' END AS type,
  row_number() OVER (ORDER BY ds_id, D1 DESC, seed) AS ID FROM g)"""
_BASE, _PAIRS, _ALL = f"WITH {_P} ", f"WITH {_P}, {_E} ", f"WITH RECURSIVE {_P}, {_E}, {_R} "


@_query("particles_normalised", _BASE + "SELECT ds_id, ID, 'P' || ID AS name, D, X, Y, round(area, 6) AS area, round(volume, 6) AS volume FROM p")
def _(spark, sf_dir):
    return _rounded(Circles(spark, sf_dir).parts)


@_query("pixel_unit_scale", f"SELECT p_brand AS ds_id, p_partkey AS ID, round(((p_partkey * 7919) % {MODULI[0]}) * 0.25, 6) AS X, round(((p_partkey * 10473) % {MODULI[1]}) * 0.25, 6) AS Y, round(p_size * 0.25, 6) AS D, round(p_size / 2.0 * 0.25, 6) AS R FROM part WHERE p_brand <> 'Brand#11'")
def _(spark, sf_dir):
    c = circles(spark, sf_dir)
    info = c.select("ds_id").distinct().withColumn("px_size", F.when(F.col("ds_id") == "Brand#11", 0.0).otherwise(0.25))
    return _rounded(particles.scale(particles.with_diameter(c), info))


@_query("dedupe_smallest_r", f"SELECT ds_id, ID, X, Y, D FROM (SELECT p_brand AS ds_id, p_partkey % 50 AS ID, ((p_partkey * 7919) % {MODULI[0]})::DOUBLE AS X, ((p_partkey * 10473) % {MODULI[1]})::DOUBLE AS Y, p_size::DOUBLE AS D, row_number() OVER (PARTITION BY p_brand, p_partkey % 50 ORDER BY p_size, (p_partkey * 7919) % {MODULI[0]}, (p_partkey * 10473) % {MODULI[1]}) AS k FROM part) WHERE k = 1")
def _(spark, sf_dir):
    c = circles(spark, sf_dir).withColumn("ID", F.col("ID") % 50)
    return particles.dedupe(particles.with_diameter(c)).select("ds_id", "ID", "X", "Y", "D")


@_query("reassign_duplicate_ids", f"SELECT ds_id, (row_number() OVER (PARTITION BY ds_id ORDER BY D DESC, ID, X, Y) - 1)::BIGINT AS ID, X, Y, D FROM (SELECT p_brand AS ds_id, p_partkey % 50 AS ID, ((p_partkey * 7919) % {MODULI[0]})::DOUBLE AS X, ((p_partkey * 10473) % {MODULI[1]})::DOUBLE AS Y, p_size::DOUBLE AS D FROM part)")
def _(spark, sf_dir):
    c = circles(spark, sf_dir).withColumn("ID", F.col("ID") % 50)
    return particles.dedupe(particles.with_diameter(c), "reassign").select("ds_id", "ID", "X", "Y", "D")


@_query("imagej_filter_recenter", "SELECT p_brand AS ds_id, p_partkey AS ID, (p_partkey % 401 + p_size / 2.0)::DOUBLE AS X, (p_partkey % 409 + p_size / 2.0)::DOUBLE AS Y, p_size::DOUBLE AS D, (p_size / 2.0)::DOUBLE AS R FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    roi = p.select(F.col("p_brand").alias("ds_id"), F.col("p_partkey").alias("Index"), F.when(F.col("p_partkey") % 5 == 0, "Rectangle").otherwise("Oval").alias("Type"), (F.col("p_partkey") % 401).cast("double").alias("X"), (F.col("p_partkey") % 409).cast("double").alias("Y"), F.col("p_size").cast("double").alias("Width"), (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).cast("double").alias("Height"))
    return particle_csv.from_imagej(roi)


@_query("largest_smallest_particle", _BASE + "SELECT ds_id, arg_max(ID, (D, -ID)) AS largest_ID, max(D) AS largest_D, arg_min(ID, (D, ID)) AS smallest_ID, min(D) AS smallest_D, (SELECT min(D) FROM p) AS all_min, (SELECT max(D) FROM p) AS all_max FROM p GROUP BY ds_id")
def _(spark, sf_dir):
    p = Circles(spark, sf_dir).parts
    hi = particles.largest(p).withColumnsRenamed({"ID": "largest_ID", "D": "largest_D"})
    lo = particles.smallest(p).withColumnsRenamed({"ID": "smallest_ID", "D": "smallest_D"})
    return hi.join(lo, "ds_id").join(particles.diameter_range(p).drop("min_D", "max_D"), "ds_id")


@_query("particles_by_id", _BASE + "SELECT pos, ds_id, ID, D FROM p JOIN (VALUES (0, 30), (1, 10), (2, 20)) v(pos, want) ON p.ID = want")
def _(spark, sf_dir):
    return particles.by_ids(Circles(spark, sf_dir).parts, [30, 10, 20]).select("pos", "ds_id", "ID", "D")


@_query("exclude_datasets", _BASE + "SELECT DISTINCT ds_id FROM p WHERE ds_id NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_partkey % 3 = 0)")
def _(spark, sf_dir):
    c = circles(spark, sf_dir)
    return particles.exclude(c.select("ds_id").distinct(), c.filter("D = 50 and ID % 3 = 0"))


@_query("datasets_without_source", _BASE + "SELECT DISTINCT ds_id FROM p WHERE ds_id NOT IN (SELECT ds_id FROM p WHERE D > 49)")
def _(spark, sf_dir):
    c = circles(spark, sf_dir)
    return particles.without_source(c.select("ds_id").distinct(), c.filter("D > 49"))


@_query("union_passes", _BASE + "SELECT ds_id, (row_number() OVER (PARTITION BY ds_id ORDER BY pass, place) - 1)::BIGINT AS ID, pass, place, D FROM (SELECT ds_id, 0 AS pass, ID AS place, D FROM p WHERE D <= 30 UNION ALL SELECT ds_id, 1, ID, D FROM p WHERE D >= 20)")
def _(spark, sf_dir):
    c = circles(spark, sf_dir).select("ds_id", F.col("ID").alias("place"), "D")
    return particles.union_passes([c.filter("D <= 30"), c.filter("D >= 20")]).select("ds_id", "ID", "pass", "place", "D")


@_query("overlap_pairs", _PAIRS + "SELECT ds_id, a, b, round(dist, 6) AS dist FROM e WHERE a < b")
def _(spark, sf_dir):
    e = overlap.edges(Circles(spark, sf_dir).pairs).filter("ID < other")
    return _rounded(e.select("ds_id", F.col("ID").alias("a"), F.col("other").alias("b"), "dist"))


@_query("overlap_degree", _PAIRS + "SELECT p.ds_id, p.ID, count(e.b) AS n_neighbours, coalesce(string_agg(e.b::VARCHAR, ',' ORDER BY e.b), '') AS neighbours FROM p LEFT JOIN e ON p.ds_id = e.ds_id AND p.ID = e.a GROUP BY p.ds_id, p.ID")
def _(spark, sf_dir):
    c = Circles(spark, sf_dir)
    return overlap.degrees(c.parts, c.pairs).withColumn("neighbours", F.array_join("neighbours", ","))


@_query("contained_particles", _PAIRS + "SELECT DISTINCT ds_id, b AS ID FROM e WHERE dist <= (Da - Db) / 2")
def _(spark, sf_dir):
    return overlap.contained(Circles(spark, sf_dir).pairs)


@_query("neighbours_of_point", _BASE + f"SELECT ds_id, ID, round(away, 6) AS dist FROM (SELECT *, sqrt((X - {NEAR[0]}) * (X - {NEAR[0]}) + (Y - {NEAR[1]}) * (Y - {NEAR[1]})) AS away FROM p) WHERE away <= {NEAR[3]} AND away <= ({NEAR[2]} + D) / 2")
def _(spark, sf_dir):
    return _rounded(overlap.neighbours_of(Circles(spark, sf_dir).parts, *NEAR).select("ds_id", "ID", "dist"))


@_query("components", _ALL + "SELECT ds_id, ID, agl FROM c")
def _(spark, sf_dir):
    return Circles(spark, sf_dir).labels()


@_query("components_distributed", _ALL + "SELECT ds_id, ID, agl FROM c")
def _(spark, sf_dir):
    return Circles(spark, sf_dir).labels("distributed")


@_query("agglomerate_basic", _ALL + "SELECT ds_id, agl, members_count, round(volume, 6) AS volume, round(D, 6) AS D, round(members_Dmean, 6) AS members_Dmean, round(members_Dstdev, 6) AS members_Dstdev FROM a")
def _(spark, sf_dir):
    return _rounded(Circles(spark, sf_dir).aggl().select("ds_id", "agl", "members_count", "volume", "D", "members_Dmean", "members_Dstdev"))


@_query("agglomerate_com_rg", _ALL + "SELECT ds_id, agl, round(X_com, 6) AS X_com, round(Y_com, 6) AS Y_com, round(Rg, 6) AS Rg, round(Dg, 6) AS Dg FROM a")
def _(spark, sf_dir):
    return _rounded(Circles(spark, sf_dir).aggl().select("ds_id", "agl", "X_com", "Y_com", "Rg", "Dg"))


@_query("agglomerate_dsom", _ALL + "SELECT ds_id, agl, idj_members_count, members_count_dsom, round(volume_dsom, 6) AS volume_dsom, round(D_dsom, 6) AS D_dsom FROM a")
def _(spark, sf_dir):
    return _rounded(Circles(spark, sf_dir).aggl_once().select("ds_id", "agl", "idj_members_count", "members_count_dsom", "volume_dsom", "D_dsom"))


@_query("agglomerate_ids", _ALL + "SELECT ds_id, agl, ID, 'AGL' || ID AS name, type FROM a")
def _(spark, sf_dir):
    return morphology.numbered(Circles(spark, sf_dir).aggl()).select("ds_id", "agl", "ID", "name", "type")


@_query("agglomerate_members", _ALL + "SELECT ds_id, agl, string_agg(ID::VARCHAR, ',' ORDER BY k) AS member_ids FROM m GROUP BY ds_id, agl")
def _(spark, sf_dir):
    return morphology.members_of(Circles(spark, sf_dir, inside=False).once()).select("ds_id", "agl", F.array_join("member_ids", ",").alias("member_ids"))


@_query("member_d_ratio", _ALL + "SELECT ds_id, ID, agl, k, round(D / max(D) OVER (PARTITION BY ds_id, agl), 6) AS D_ratio FROM m")
def _(spark, sf_dir):
    return _rounded(Circles(spark, sf_dir, inside=False).once().select("ds_id", "ID", "agl", F.col("k").cast("long").alias("k"), "D_ratio"))


@_query("classify_agglomerates", _ALL + "SELECT ds_id, type, count(*) AS n, sum(members_count)::BIGINT AS members FROM a GROUP BY ds_id, type")
def _(spark, sf_dir):
    return Circles(spark, sf_dir, inside=False).aggl_once().groupBy("ds_id", "type").agg(F.count("*").alias("n"), F.sum("members_count").alias("members"))


@_query("classify_particles", _ALL + "SELECT m.ds_id, m.ID, m.idj, CASE WHEN a.type <> 'collector' THEN a.type WHEN m.k = 1 THEN 'collector' ELSE 'attached2coll' END AS type, 'AGL' || a.ID AS affiliation FROM m JOIN a ON m.ds_id = a.ds_id AND m.agl = a.agl")
def _(spark, sf_dir):
    m = Circles(spark, sf_dir).members()
    return morphology.classify_particles(m, morphology.numbered(morphology.agglomerates(m))).select("ds_id", "ID", "idj", "type", "affiliation")


_PART_SQL = "count(*) AS N_primary_particle, avg(D) AS particle_Dmean, stddev_samp(D) AS particle_Dstd, quantile_cont(D, 0.1) AS particle_D10, quantile_cont(D, 0.5) AS particle_D50, quantile_cont(D, 0.9) AS particle_D90, sum(pow(D, 3)) / sum(pow(D, 2)) AS particle_SMD"
_AGL_SQL = "count(*) AS N_aerosol_particle, count(*) FILTER (WHERE members_count = 1) AS N_pp1, count(*) FILTER (WHERE type = 'collector') AS N_collector_agl, count(*) FILTER (WHERE type = 'similar') AS N_similar_agl, count(*) FILTER (WHERE type = 'separate') AS N_pp1_separate, avg(members_count) AS agl_member_count_mean, stddev_samp(members_count) AS agl_member_count_std"
_RATIO_SQL = "N_primary_particle - N_pp1 AS N_ppA, N_aerosol_particle - N_pp1 AS N_agl, 1 - N_pp1_separate / N_primary_particle AS ER, (N_aerosol_particle - N_pp1) / N_primary_particle AS Ra, N_pp1_separate / nullif(N_collector_agl + N_similar_agl, 0) AS sep2agl, (N_primary_particle - N_pp1) / nullif(N_aerosol_particle - N_pp1, 0) AS n_ppA_mean, N_primary_particle / nullif(N_aerosol_particle, 0) AS n_ppP_mean"
_FLOATS = {x for x in summary.DS_COLUMNS if not x.startswith("N_") and x != "ds_id"}


@_query("ds_summary", _ALL + f"SELECT {', '.join(f'round({x}, 6) AS {x}' if x in _FLOATS else x for x in summary.DS_COLUMNS)} FROM (SELECT *, {_RATIO_SQL} FROM (SELECT ds_id, {_PART_SQL} FROM p GROUP BY ds_id) JOIN (SELECT ds_id, {_AGL_SQL} FROM a GROUP BY ds_id) USING (ds_id))")
def _(spark, sf_dir):
    c = Circles(spark, sf_dir)
    return _rounded(summary.dataset_summary(c.parts, c.aggl()))


@_query("pooled_summary", _ALL + f", one AS (SELECT *, {_RATIO_SQL} FROM (SELECT {_PART_SQL} FROM p), (SELECT {_AGL_SQL}, avg(D) AS agl_Dmean, stddev_samp(D) AS agl_Dstd, quantile_cont(D, 0.1) AS agl_D10, quantile_cont(D, 0.5) AS agl_D50, quantile_cont(D, 0.9) AS agl_D90, quantile_cont(members_count, 0.1) AS agl_member_count_q10, quantile_cont(members_count, 0.5) AS agl_member_count_q50, quantile_cont(members_count, 0.9) AS agl_member_count_q90 FROM a)) " + " UNION ALL ".join(f"SELECT '{x}' AS metric, round(({x})::DOUBLE, 6) AS value FROM one" for x in summary.POOLED))
def _(spark, sf_dir):
    c = Circles(spark, sf_dir, inside=False)
    # Written, not cached: a plan that repeats all of theirs for each step of the ranks takes the driver's memory.
    return _rounded(summary.pooled_summary(c.parts, components.cut(c.aggl_once().select("D", "members_count", "type"))))


def _bins_sql(edges: list[float]) -> str:
    return "bins(bin, l, r) AS (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + ")"


def _dist_sql(head: str, source: str, column: str, edges: str | list[float], volume: bool = True) -> str:
    bins = edges if isinstance(edges, str) else _bins_sql(edges)
    more = ", round(volume, 6) AS volume, round(sum(volume) OVER w, 6) AS volume_cummulative, round(volume / nullif(sum(volume) OVER (), 0), 6) AS volume_norm, round(sum(volume) OVER w / nullif(sum(volume) OVER (), 0), 6) AS volume_cummulative_norm" if volume else ""
    return f"""{head}, {bins}, h AS (SELECT bin, l, r, count(v) AS counts FROM bins LEFT JOIN (SELECT {column}::DOUBLE AS v FROM {source}) ON (v > l AND v <= r) OR (bin = 0 AND v = l) GROUP BY bin, l, r),
h2 AS (SELECT *, (l + r) / 2 AS mid, counts * pi() / 6 * pow((l + r) / 2, 3) AS volume FROM h)
SELECT bin, round(l, 6) AS "left", round(mid, 6) AS mid, round(r, 6) AS "right", round(r - l, 6) AS width, counts, (sum(counts) OVER w)::BIGINT AS cummulative, round(counts / nullif(sum(counts) OVER (), 0), 6) AS counts_norm, round(sum(counts) OVER w / nullif(sum(counts) OVER (), 0), 6) AS cummulative_norm{more}
FROM h2 WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _dist(source, column: str, edges: list[float] | None, volume: bool = True, inside: bool = True):
    def run(spark, sf_dir):
        df = source(Circles(spark, sf_dir, inside=inside))
        e = edges or histogram.auto_edges(df, column)
        return _rounded(histogram.distribution(df, column, e, volume))

    return run


for _name, _edges in (("psd_linear", LINEAR), ("psd_log", LOGGED), ("psd_step", STEPPED)):
    _query(_name, _dist_sql(_BASE, "p", "D", _edges))(_dist(lambda c: c.parts, "D", _edges))
_AUTO = "lim AS (SELECT pow(10, floor(log10(min(D)))) AS lo, pow(10, ceil(log10(max(D)))) AS hi FROM p), bins AS (SELECT i AS bin, lo + (hi - lo) / 20 * i AS l, CASE WHEN i = 19 THEN hi ELSE lo + (hi - lo) / 20 * (i + 1) END AS r FROM lim, range(20) t(i))"
_query("psd_auto", _dist_sql(_BASE, "p", "D", _AUTO).replace("SELECT bin,", "SELECT bin::INT AS bin,"))(_dist(lambda c: c.parts, "D", None))
_query("agl_psd", _dist_sql(_ALL, "a", "D", LINEAR))(_dist(lambda c: c.aggl_once(), "D", LINEAR, inside=False))
_query("agl_psd_dsom", _dist_sql(_ALL, "a", "D_dsom", LINEAR))(_dist(lambda c: c.aggl_once(), "D_dsom", LINEAR))
for _name, _column, _edges, _volume in (("agl_pcd", "members_count", COUNTED, False), ("agl_pcd_dsom", "members_count_dsom", COUNTED, False)):
    _query(_name, _dist_sql(_ALL, "a", _column, _edges, _volume))(_dist(lambda c: c.aggl(), _column, _edges, _volume))


@_query("distribution_select", f"SELECT \"right\", cummulative_norm FROM ({_dist_sql(_BASE, 'p', 'D', LINEAR)})")
def _(spark, sf_dir):
    d = histogram.distribution(Circles(spark, sf_dir).parts, "D", LINEAR)
    return _rounded(histogram.select_distribution(d, "right", norm=True, cumulative=True))


@_query("magnitude_floor_ceil", "SELECT p_partkey AS ID, round(pow(10, floor(log10(p_retailprice))), 6) AS floor10, round(pow(10, ceil(log10(p_retailprice))), 6) AS ceil10, round(floor(p_retailprice / pow(10, floor(log10(p_retailprice)))) * pow(10, floor(log10(p_retailprice))), 6) AS floor_step, round(ceil(p_retailprice / pow(10, floor(log10(p_retailprice)))) * pow(10, floor(log10(p_retailprice))), 6) AS ceil_step FROM part")
def _(spark, sf_dir):
    v = F.col("p_retailprice")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return _rounded(p.select(F.col("p_partkey").alias("ID"), geometry.floor_to_magnitude(v).alias("floor10"), geometry.ceil_to_magnitude(v).alias("ceil10"), geometry.floor_to_magnitude(v, False).alias("floor_step"), geometry.ceil_to_magnitude(v, False).alias("ceil_step")))


@_query("magnification_parse", "SELECT p_partkey AS ID, p_size * CASE WHEN p_partkey % 2 = 0 THEN 1000.0 ELSE 1.0 END AS magnification, round(p_size * CASE p_partkey % 3 WHEN 0 THEN 1e-3 WHEN 1 THEN 1.0 ELSE 1e6 END, 6) AS pixel_um FROM part")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat_ws(" ", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "K"), F.lit("X"))
    unit = F.element_at(F.array(F.lit("nm"), F.lit("µm"), F.lit("m")), (F.col("p_partkey") % 3 + 1).cast("int"))
    tags = F.create_map(F.lit("ap_pixel_size"), F.concat_ws("|", F.lit("Pixel"), F.col("p_size").cast("string"), unit))
    return _rounded(p.select(F.col("p_partkey").alias("ID"), units.magnification(text).alias("magnification"), (units.pixel_size(tags) * 1e6).alias("pixel_um")))


@_query("param_broadcast", "SELECT * FROM (VALUES (0, 3, 50, 0.4), (1, 50, 140, 0.4)) t(pass, d_min, d_max, dist2R)")
def _(spark, sf_dir):
    rows = values.zip_parameters(d_min=[3, 50], d_max=[50, 140], dist2R=0.4)
    return spark.createDataFrame([(i, r["d_min"], r["d_max"], r["dist2R"]) for i, r in enumerate(rows)], "pass int, d_min int, d_max int, dist2R double")


@_query("particle_colours", _ALL + "SELECT ds_id, agl, CASE type WHEN 'collector' THEN 'blue' WHEN 'similar' THEN 'red' ELSE 'lime' END AS colour, round((members_count - min(members_count) OVER (PARTITION BY ds_id)) / nullif(max(members_count) OVER (PARTITION BY ds_id) - min(members_count) OVER (PARTITION BY ds_id), 0), 6) AS shade FROM a")
def _(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("ds_id")
    lo, hi = F.min("members_count").over(w), F.max("members_count").over(w)
    return _rounded(Circles(spark, sf_dir, inside=False).aggl_once().select("ds_id", "agl", geometry.type_colour(F.col("type")).alias("colour"), geometry.ratio(F.col("members_count") - lo, hi - lo).alias("shade")))


# ---- sources, helpers -------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    from granulo.operators.components import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv_of(spark: SparkSession, sf_dir: str, where: str, columns: dict, separator: str = ",") -> str:
    """Circles of part written as files with a header; columns: name and expression over ds_id, ID, X, Y, D."""
    folder = _folder(spark, "csv")
    circles(spark, sf_dir).filter(where).select(*[F.expr(e).alias(n) for n, e in columns.items()]).write.option("header", True).option("sep", separator).csv(folder)
    return folder


NATIVE = {"ID": "ID", "X": "X", "Y": "Y", "R": "D / 2"}
LEGACY = {"ID": "ID", "X (pixels)": "X", "Y (pixels)": "Y", "Radius (pixels)": "D / 2"}
REGIONS = {"Index": "ID", "Name": "'r'", "Type": "if(ID % 5 = 0, 'Rectangle', 'Oval')", "X": "X", "Y": "Y", "Width": "D", "Height": "if(ID % 7 = 0, D + 1, D)"}
_READ = "SELECT 'all' AS ds_id, ID, X, Y, D / 2 AS R FROM p"


@_query("csv_native", _BASE + _READ)
def _(spark, sf_dir):
    return particle_csv.load(spark, _csv_of(spark, sf_dir, "true", NATIVE), "all").select("ds_id", "ID", "X", "Y", "R")


@_query("csv_legacy", _BASE + _READ)
def _(spark, sf_dir):
    return particle_csv.load(spark, _csv_of(spark, sf_dir, "true", LEGACY), "all").select("ds_id", "ID", "X", "Y", "R")


@_query("csv_regions", _BASE + "SELECT 'all' AS ds_id, ID, X + D / 2 AS X, Y + D / 2 AS Y, D, D / 2 AS R FROM p WHERE ID % 5 <> 0 AND ID % 7 <> 0")
def _(spark, sf_dir):
    return particle_csv.load(spark, _csv_of(spark, sf_dir, "true", REGIONS), "all")


@_query("csv_dropped_regions", _BASE + "SELECT ID::VARCHAR AS Index FROM p WHERE ID % 5 = 0 OR ID % 7 = 0")
def _(spark, sf_dir):
    df = spark.read.option("header", True).csv(_csv_of(spark, sf_dir, "true", REGIONS))
    return particle_csv.dropped(df)


@_query("csv_layouts", "SELECT * FROM (VALUES ('native'), ('imagej'), ('legacy')) t(layout)")
def _(spark, sf_dir):
    paths = [_csv_of(spark, sf_dir, "ID < 50", c) for c in (NATIVE, REGIONS, LEGACY)]
    return spark.createDataFrame([(particle_csv.recognise(particle_csv.header(spark, p)),) for p in paths], "layout string")


@_query("csv_given_layout", _BASE + "SELECT p.ds_id, p.ID, p.X, p.Y, p.D / 2 AS R FROM p WHERE ds_id IN ('Brand#11', 'Brand#22', 'Brand#3')")
def _(spark, sf_dir):
    """Files of several layouts, each with its data set, in one table."""
    every = None
    for name, columns in (("Brand#11", NATIVE), ("Brand#22", LEGACY), ("Brand#3", {"ID": "ID", "X": "X", "Y": "Y", "R": "D / 2", "Width": "D"})):
        one = particle_csv.load(spark, _csv_of(spark, sf_dir, f"ds_id = '{name}'", columns), name).select("ds_id", "ID", "X", "Y", "R")
        every = one if every is None else every.unionByName(one)
    return every


@_query("legacy_key_values", "SELECT 'k' || p_partkey AS key, p_size::VARCHAR AS value, CASE WHEN p_partkey % 3 = 0 THEN 'um' END AS unit FROM part")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat_ws(";", F.concat(F.lit(" k"), "p_partkey"), F.concat(F.col("p_size"), F.lit(" ")), F.when(F.col("p_partkey") % 3 == 0, "um"))
    folder = _folder(spark, "keys")
    p.select(line.alias("value")).write.text(folder)
    return legacy.key_values(spark, folder).select("key", "value", "unit")


@_query("legacy_ignore_list", "SELECT DISTINCT p_brand AS name FROM part WHERE p_brand LIKE '%1' AND p_brand <> 'Brand#11' OR p_brand = 'Brand#55'")
def _(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("name")).distinct()
    ignored = names.filter("name LIKE '%1'")
    return legacy.deactivate(legacy.activate(ignored, names.filter("name = 'Brand#11'")), names.filter("name IN ('Brand#55', 'Brand#21')"))


@_query("legacy_not_ignored", "SELECT DISTINCT p_brand AS ds_id FROM part p WHERE NOT EXISTS (SELECT 1 FROM part i WHERE i.p_brand LIKE '%1' AND contains('old ' || i.p_brand, p.p_brand))")
def _(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("ds_id")).distinct()
    return legacy.not_ignored(names, names.filter("ds_id LIKE '%1'").select(F.concat(F.lit("old "), "ds_id").alias("name")))


@_query("append_members", _BASE + "SELECT ds_id, ID, 0::BIGINT AS agl FROM p WHERE ID % 3 <> 0 UNION SELECT ds_id, ID, 0::BIGINT FROM p WHERE ID % 2 = 0")
def _(spark, sf_dir):
    p = Circles(spark, sf_dir).parts.select("ds_id", "ID", F.lit(0).cast("long").alias("agl"))
    return morphology.append_members(p.filter("ID % 3 <> 0"), p.filter("ID % 2 = 0"))


@_query("agglomerate_member", _ALL + "SELECT ds_id, agl, ID, D, k FROM m WHERE (ds_id, agl, ID) = (SELECT (ds_id, agl, max(ID)) FROM m GROUP BY ds_id, agl HAVING count(*) > 1 ORDER BY ds_id, agl LIMIT 1)")
def _(spark, sf_dir):
    m = Circles(spark, sf_dir).members()
    ds, agl, i = m.groupBy("ds_id", "agl").agg(F.max("ID").alias("ID"), F.count("*").alias("n")).filter("n > 1").orderBy("ds_id", "agl").select("ds_id", "agl", "ID").first()
    return morphology.member(m, ds, agl, i).select("ds_id", "agl", "ID", "D", F.col("k").cast("long").alias("k"))


_query("psd_text_edges", _dist_sql(_BASE, "p", "D", histogram.bin_edges(0, 40, 8)))(_dist(lambda c: c.parts, "D", histogram.parse_edges("0, 40, 8", 0, 1)))
_query("psd_text_list", _dist_sql(_BASE, "p", "D", [0.0, 5.0, 10.0, 45.0]))(_dist(lambda c: c.parts, "D", histogram.parse_edges("[0, 5, 10, 45]", 0, 1)))


@_query("missing_scale", "SELECT DISTINCT p_brand AS ds_id FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')")
def _(spark, sf_dir):
    c = circles(spark, sf_dir)
    size = F.when(F.col("ds_id") == "Brand#11", 0.0).when(F.col("ds_id") != "Brand#12", 0.25)
    return particles.missing_scale(c, c.select("ds_id").distinct().withColumn("px_size", size))


@_query("text_values", "SELECT * FROM (VALUES ('1', true, false, false), ('yes', true, false, false), ('no', false, false, false), ('Auto', false, true, false), ('NaN', false, false, true), ('', false, false, true), ('true', true, false, false), ('0', false, false, false)) t(text, is_true, is_default, is_none)")
def _(spark, sf_dir):
    rows = [(x, values.is_true(x), values.is_default(x), values.is_none(x)) for x in ("1", "yes", "no", "Auto", "NaN", "", "true", "0")]
    return spark.createDataFrame(rows, "text string, is_true boolean, is_default boolean, is_none boolean")


@_query("colour_values", "SELECT p_partkey AS ID, trunc(p_size / 51.0 * 255)::INT AS red, round((p_size % 256) / 255.0, 6) AS unit, least(255, greatest(0, trunc(p_size * 5 * (1 - (p_partkey % 5 - 1) / 4.0))))::INT AS shaded, p_size % 256 AS opacity FROM part")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    red = F.get(geometry.rgb_to_256(F.array(size / F.lit(51.0))), F.lit(0))
    unit = F.get(geometry.rgb_to_unit(F.array(size % 256)), F.lit(0))
    shade = geometry.rgb_shade(F.array(size * 5, size, size, size % 256), (F.col("p_partkey") % 5 - 1) / F.lit(4.0))
    return _rounded(p.select(F.col("p_partkey").alias("ID"), red.alias("red"), unit.alias("unit"), F.get(shade, F.lit(0)).alias("shaded"), F.get(shade, F.lit(3)).alias("opacity")))


@_query("interpolated_colours", "SELECT i AS x, round(CASE WHEN i <= 2 THEN 0.0 WHEN i <= 6 THEN (i - 2) / 4.0 WHEN i <= 8 THEN 1 - (i - 6) / 4.0 ELSE 0.5 END, 6) AS value FROM range(11) t(i)")
def _(spark, sf_dir):
    rows = [(i, float(values.interpolate_colours([0.0, 1.0, 0.5], [2.0, 6.0, 8.0], float(i)))) for i in range(11)]
    return _rounded(spark.createDataFrame(rows, "x long, value double"))


@_query("unit_metres", "SELECT * FROM (VALUES ('nm', 1e-9::DOUBLE), ('µm', 1e-6::DOUBLE), ('m', 1.0::DOUBLE), ('ft', NULL)) t(unit, metres)")
def _(spark, sf_dir):
    return spark.createDataFrame([("nm",), ("µm",), ("m",), ("ft",)], "unit string").select("unit", units.unit_metres(F.col("unit")).alias("metres"))


@_query("drawn_circles", _ALL + """, f AS (SELECT m.ds_id, m.ID, m.X, m.Y, m.D, CASE a.type WHEN 'collector' THEN 'blue' WHEN 'similar' THEN 'red' ELSE 'lime' END AS c FROM m JOIN a ON m.ds_id = a.ds_id AND m.agl = a.agl)
SELECT ds_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || ceil(max(X + D / 2))::BIGINT || ' ' || ceil(max(Y + D / 2))::BIGINT || '">' ||
  string_agg('<circle cx="' || X || '" cy="' || Y || '" r="' || (D / 2) || '" fill="' || c || '" fill-opacity="0.2" stroke="' || c || '"/>', '' ORDER BY D DESC, ID) || '</svg>' AS svg FROM f GROUP BY ds_id""")
def _(spark, sf_dir):
    m = Circles(spark, sf_dir, inside=False).once().drop("name", "D_ratio").cache()
    c = morphology.classify_particles(m, morphology.agglomerates(m))
    return drawing.overlay(c, drawing.colour_by_type(), labels=False)


# ---- contract ---------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """The summary of each data set of the smallest tables."""
    c = Circles(spark, "/root/testdata/sf0.001", (101, 103))
    return summary.dataset_summary(c.parts, c.aggl())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(_Q)
    for module in _optional():
        out |= module.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(_SQL)
    for module in _optional():
        out |= module.oracle_sql()
    return out
