"""What agglomerates are like, and of which type they and their particles are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulo.errors import AgglomerateError
from granulo.functions import geometry as G

THRESHOLD = 0.5
#: Order of columns of an agglomerate table.
COLUMNS = ["ds_id", "ID", "name", "volume", "volume_dsom", "D", "D_dsom", "X_com", "Y_com", "Rg", "Dg", "type", "members_count", "idj_members_count", "members_count_dsom", "members_Dmean", "members_Dstdev", "agl"]


def membership(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """parts with agl, the place k of each member by size, and its D over the largest of its agglomerate (D_ratio)."""
    m = parts.join(labels, ["ds_id", "ID"])
    w = Window.partitionBy("ds_id", "agl").orderBy(F.col("D").desc(), F.col("ID"))
    largest = F.first("D").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return m.withColumns({"k": F.row_number().over(w), "D_ratio": G.ratio(F.col("D"), largest)})


def agglomerates(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each agglomerate, but for its number. Members: of membership(); without idj nothing is said of contained ones.

    Radii of gyration come from distances to the centre of mass, which needs a first aggregation; the window shares its
    partitioning with the second. Centres and radii of agglomerates without area are null."""
    w = Window.partitionBy("ds_id", "agl")
    com = lambda c: G.ratio(F.sum(F.col("area") * F.col(c)).over(w), F.sum("area").over(w))
    m = members.withColumn("X_com", com("X")).withColumn("Y_com", com("Y"))
    off = F.pow(F.col("X") - F.col("X_com"), F.lit(2.0)) + F.pow(F.col("Y") - F.col("Y_com"), F.lit(2.0))
    flagged = "idj" in members.columns
    hidden = [F.sum(F.when(F.col("idj"), F.col("volume")).otherwise(0.0)).alias("hidden"), F.count_if("idj").alias("idj_members_count")] if flagged else []
    a = m.groupBy("ds_id", "agl").agg(
        F.sum("volume").alias("volume"), *hidden, F.first("X_com").alias("X_com"), F.first("Y_com").alias("Y_com"),
        F.sqrt(G.ratio(F.sum(F.col("area") * off), F.sum("area"))).alias("Rg"), F.count("*").alias("members_count"),
        F.avg("D").alias("members_Dmean"), F.stddev_samp("D").alias("members_Dstdev"), F.max(F.when(F.col("k") == 1, F.col("D"))).alias("D1"), F.max(F.when(F.col("k") == 2, F.col("D"))).alias("D2"),
        F.max(F.when(F.col("k") == 1, F.col("ID"))).alias("seed"),
    )
    a = a.withColumn("D", G.sphere_diameter(F.col("volume"))).withColumn("Dg", F.col("Rg") * 2)
    if flagged:
        a = a.withColumn("volume_dsom", F.col("volume") + F.col("hidden")).withColumn("D_dsom", G.sphere_diameter(F.col("volume_dsom"))).withColumn("members_count_dsom", F.col("members_count") + F.col("idj_members_count"))
    kind = F.when(F.col("members_count") == 1, "separate").when(G.ratio(F.col("D2"), F.col("D1")) <= threshold, "collector").otherwise("similar")
    return a.withColumn("type", kind).drop("hidden", "D2")


def numbered(aggl: DataFrame) -> DataFrame:
    """COLUMNS with ID from 1, data sets in order of ds_id and in each the seeds from large to small. Numbers within a data
    set come from a window there, and their offsets from a running count over data sets."""
    seed = Window.partitionBy("ds_id").orderBy(F.col("D1").desc(), F.col("seed"))
    counts = aggl.groupBy("ds_id").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("ds_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = aggl.withColumn("k", F.row_number().over(seed)).join(before, "ds_id").withColumn("ID", (F.col("k") + F.col("before")).cast("long"))
    return out.withColumn("name", F.concat(F.lit("AGL"), F.col("ID").cast("string"))).select(*COLUMNS)


def classify_particles(members: DataFrame, aggl: DataFrame) -> DataFrame:
    """members with type and affiliation. aggl: of numbered(), or of agglomerates(), which have no name to be affiliated to."""
    named = [F.col("name").alias("affiliation")] if "name" in aggl.columns else []
    a = aggl.select("ds_id", "agl", F.col("type").alias("kind"), *named)
    kind = F.when(F.col("kind") != "collector", F.col("kind")).when(F.col("k") == 1, "collector").otherwise("attached2coll")
    return members.join(a, ["ds_id", "agl"]).withColumn("type", kind).drop("kind")


def append_members(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (ds_id, ID, agl) with further ones; who is a member already stays once."""
    return labels.unionByName(more.select("ds_id", "ID", "agl")).dropDuplicates(["ds_id", "ID", "agl"])


def members_of(members: DataFrame) -> DataFrame:
    """For each agglomerate its members' IDs and diameters, from large to small."""
    rows = F.sort_array(F.collect_list(F.struct("k", "ID", "D")))
    return members.groupBy("ds_id", "agl").agg(rows.alias("m")).select("ds_id", "agl", F.col("m.ID").alias("member_ids"), F.col("m.D").alias("member_Ds"))


def member(members: DataFrame, ds_id: str, agl: int, particle: int) -> DataFrame:
    """The row of a member of an agglomerate, by its ID; who isn't one raises."""
    row = members.filter((F.col("ds_id") == ds_id) & (F.col("agl") == agl) & (F.col("ID") == particle))
    if row.limit(1).count() == 0:
        raise AgglomerateError(f"particle {particle} is no member of agglomerate {agl} of {ds_id}")
    return row
