"""A batch: any number of images, from their particles to all reports, as one lazy plan for each table."""

from __future__ import annotations

from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulo import sinks
from granulo.errors import EmptySourceError
from granulo.operators import clusters, drawing, histogram, morphology, overlap, particles, summary, touching, vision
from granulo.sources import directory, images, particle_csv
from granulo.sources import settings as S


class Batch:
    """Tables follow from a source (ds_id, ID, X, Y and D or R, in pixels) and info (ds_id, px_size)."""

    def __init__(self, source: DataFrame, info: DataFrame | None = None, threshold: float = morphology.THRESHOLD, duplicate_id: str = "last", components: str = "auto", conditions: dict | None = None):
        if source.limit(1).count() == 0:
            raise EmptySourceError("the source has no particles")
        if info is not None:
            particles.require_scale(source, info)
        self.spark: SparkSession = source.sparkSession
        self.source, self.info, self.threshold, self.duplicate_id, self.method = source, info, threshold, duplicate_id, components
        self.conditions = conditions or {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, force_detection: bool = False, **options) -> Batch:
        """From a working directory. Data sets with a particle file take it; the others, or all with force_detection, are
        searched for circles."""
        s = S.load(directory.settings_file(path))
        sets = directory.datasets(path, s)
        files = {} if force_detection else directory.particle_files(path, s)
        rows = particle_csv.load_many(spark, files) if files else None
        scan = images.scan(spark, [str(p.parent) for p in sets.values()])
        for name in sets.keys() - files.keys():
            image = s["data"]["images"][name]
            one = vision.detect(scan.filter(F.col("ds_id") == name), *[image[k] for k in S.DETECTION], crop_ratio=image["crop_ratio"], median=image["median_blur"])
            rows = one if rows is None else rows.unionByName(one)
        told = spark.createDataFrame([(k, _number(s["data"]["images"][k]["magnification"]), _number(s["data"]["images"][k]["pixel_size"])) for k in sets], "ds_id string, mag__ double, px__ double")
        info = images.info(scan).drop("tags").join(F.broadcast(told), "ds_id")
        info = info.select("ds_id", "img_name", F.coalesce("mag__", "magnification").alias("magnification"), F.coalesce("px__", "px_size").alias("px_size"), (F.col("px__").isNull() & F.col("old_format")).alias("old_format"), F.concat(F.lit(f"{directory.IMAGES}/"), F.col("ds_id")).alias("subdir"))
        batch = cls(rows, info, s["analysis"]["collector_threshold"], conditions=s["metadata"]["conditions"], **options)
        batch.bins, batch.path = s["analysis"]["PSD_space"], str(path)
        return batch

    bins: dict | None = None
    path: str | None = None

    def __repr__(self) -> str:
        """Where it is from and how it works; nothing is counted for it."""
        return f"Batch(path={self.path!r}, threshold={self.threshold}, duplicate_id={self.duplicate_id!r}, components={self.method!r})"

    def described(self) -> DataFrame:
        """(DS ID, ID, text): each particle in words."""
        d = F.format_string("%s: D=%.4g at (%.4g, %.4g), %s of %s", "name", "D", "X", "Y", "type", "affiliation")
        return self.classified.select(F.col("ds_id").alias("DS ID"), "ID", d.alias("text"))

    def pictures(self, by: str = "type", labels: bool = True, alpha: float = 0.2) -> DataFrame:
        """(ds_id, svg): each image's circles, in its pixels, coloured by type or by a column of particles."""
        rows = self.classified.select("ds_id", "ID", "X", "Y", "D", "area", "volume", "type")
        if self.info is not None:
            px = self.info.select("ds_id", "px_size")
            rows = rows.join(px, "ds_id").withColumns({c: F.col(c) / F.col("px_size") for c in ("X", "Y", "D")})
        return drawing.overlay(rows, drawing.colour_by_type() if by == "type" else drawing.colour_by(by), alpha, labels)

    @cached_property
    def particles(self) -> DataFrame:
        return particles.particles(self.source, self.info, self.duplicate_id).cache()

    @cached_property
    def pairs(self) -> DataFrame:
        return overlap.overlap_pairs(self.particles).cache()

    @cached_property
    def nodes(self) -> DataFrame:
        return touching.nodes(self.particles).cache()

    @cached_property
    def members(self) -> DataFrame:
        labels = clusters.components(self.particles, touching.links(self.nodes), self.method)
        return morphology.membership(touching.flag_contained(self.particles, self.nodes), labels)

    @cached_property
    def agglomerates(self) -> DataFrame:
        return morphology.numbered(morphology.agglomerates(self.members, self.threshold)).cache()

    @cached_property
    def classified(self) -> DataFrame:
        return morphology.classify_particles(self.members, self.agglomerates)

    def particle_table(self, coordinates: bool = False) -> DataFrame:
        at = ["X", "Y"] if coordinates else []
        return self.classified.select(F.col("ds_id").alias("DS ID"), "ID", "name", "D", *at, "area", "volume", "type", "affiliation", "idj")

    def agglomerate_table(self) -> DataFrame:
        return self.agglomerates.drop("agl").withColumnRenamed("ds_id", "DS ID")

    def _edges(self, values: DataFrame, column: str, edges: list[float] | None) -> list[float]:
        return edges or (histogram.bin_edges(**self.bins) if self.bins else histogram.auto_edges(values, column))

    def psd(self, edges: list[float] | None = None, label_mode: str = "exact") -> DataFrame:
        return histogram.distribution(self.particles, "D", self._edges(self.particles, "D", edges), label_mode=label_mode)

    def agl_psd(self, edges: list[float] | None = None, include_dsom: bool = False, label_mode: str = "exact") -> DataFrame:
        column = "D_dsom" if include_dsom else "D"
        return histogram.distribution(self.agglomerates, column, self._edges(self.agglomerates, column, edges), label_mode=label_mode)

    def agl_pcd(self, edges: list[float], include_dsom: bool = False) -> DataFrame:
        return histogram.distribution(self.agglomerates, "members_count_dsom" if include_dsom else "members_count", edges, volume=False)

    def dataset_summary(self) -> DataFrame:
        return summary.dataset_summary(self.particles, self.agglomerates)

    def pooled_summary(self) -> DataFrame:
        return summary.pooled_summary(self.particles, self.agglomerates)

    def export(self, folder: str, pcd_edges: list[float], edges: list[float] | None = None, form: str = "parquet") -> None:
        """All results as nine tables."""
        conditions = self.spark.createDataFrame([(k, float(v[0]), str(v[1])) for k, v in self.conditions.items()], "condition string, value double, unit string")
        sinks.write_tables({
            "conditions": conditions, "img_info": self.info if self.info is not None else self.particles.select("ds_id").distinct(), "summary": self.pooled_summary(), "datasets_summary": self.dataset_summary(),
            "psd": self.psd(edges), "agl_psd": self.agl_psd(edges), "agl_pcd": self.agl_pcd(pcd_edges), "particle_data": self.particle_table(), "agl_data": self.agglomerate_table(),
        }, str(Path(folder)) if "://" not in folder else folder, form)


def _number(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) else None
