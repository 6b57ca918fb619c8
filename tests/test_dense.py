"""Components and containment without a list of pairs: against brute force, and in the queries that need no pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_engine import SCHEMA, brute, made
from test_entry import same

import __spark_entry__ as entry
from granulo.operators import clusters, morphology, overlap, particles, summary, touching

#: Queries that would list all pairs of a dense table for nothing.
WITHOUT_PAIRS = ["classify_particles", "member_d_ratio", "particle_colours", "pooled_summary", "agglomerate_dsom", "agglomerate_members", "agl_psd", "agl_psd_dsom", "classify_agglomerates", "drawn_circles"]


def odd(name):
    r = random.Random(5)
    if name == "lattice":
        return [("a", i, float(r.randrange(150)), float(r.randrange(150)), float(r.randint(1, 50))) for i in range(1200)]
    if name == "powers":
        return [("a", i, r.uniform(-900, 900), r.uniform(-900, 900), r.choice([0.0, 0.001, 0.5, 1.0, 4.0, 16.0, 64.0, 128.0, 300.0])) for i in range(800)]
    if name == "equal":
        return [("a", i, r.gauss(0, 30), r.gauss(0, 30), 10.0) for i in range(800)]
    if name == "far":
        return [("a", i, 1e9 + r.random() * 50, -1e9 + r.random() * 50, r.random() * 5) for i in range(500)]
    if name == "tangents":
        return [("a", i, r.randrange(40) * 5.0, r.randrange(40) * 5.0, r.choice([5.0, 5.0, 2.0])) for i in range(400)]
    if name == "none or below":
        return [("a", i, r.uniform(0, 9), r.uniform(0, 9), r.choice([-1.0, 0.0, 3.0, -3.0])) for i in range(300)]
    return made(3, n=200, giant=name == "giant")


NAMES = ["lattice", "powers", "equal", "far", "tangents", "none or below", "made", "giant"]


@pytest.mark.parametrize("name", NAMES)
def test_nodes_match_brute_force(spark, monkeypatch, name):
    rows = odd(name)
    parts = particles.derive(spark.createDataFrame(rows, SCHEMA))
    _, inside, roots = brute(rows)
    nodes = touching.nodes(parts).cache()
    assert {(r.ds_id, r.ID) for r in touching.flag_contained(parts, nodes).filter("idj").collect()} == inside
    assert {(r.ds_id, r.ID): r.agl for r in clusters.components(parts, touching.links(nodes)).collect()} == roots
    # Batches of a few tiles and comparisons in small steps change nothing.
    key = ["ds_id", "at", "tx", "ty"]
    dealt = touching._dealt(parts).toArrow().sort_by([(k, "ascending") for k in key]).to_batches(max_chunksize=40)
    monkeypatch.setattr(touching, "BATCH", 60)
    monkeypatch.setattr(touching, "CHUNK", 100)
    told = [r for b in touching._worked(iter(dealt)) for r in b.to_pylist()]
    assert {(r["ds_id"], r["ID"]) for r in told if r["idj"]} == inside
    again = spark.createDataFrame([(r["ds_id"], r["ID"], r["root"], r["idj"]) for r in told], "ds_id string, ID long, root long, idj boolean")
    assert {(r.ds_id, r.ID): r.agl for r in clusters.components(parts, touching.links(again)).collect()} == roots


def test_nodes_grow_with_circles_not_with_pairs(spark):
    n = 4000
    c = spark.range(n).select(F.lit("a").alias("ds_id"), F.col("id").alias("ID"), ((F.col("id") * 7919) % 101).cast("double").alias("X"), ((F.col("id") * 10473) % 103).cast("double").alias("Y"), (F.col("id") % 50 + 1).cast("double").alias("D"))
    parts = particles.derive(c)
    assert overlap.overlap_pairs(parts).count() > 200 * n
    assert touching.nodes(parts).count() < 4 * n


def test_circles_without_place_or_size_touch_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, 0.0, 0.0, 5.0), ("a", 2, 1.0, 0.0, 5.0), ("a", 3, nan, 0.0, 5.0), ("a", 4, 0.0, inf, 5.0), ("a", 5, 0.0, 0.0, None), ("a", 6, None, 0.0, 5.0)]
    parts = particles.derive(spark.createDataFrame(rows, SCHEMA))
    assert {r.ID: r.agl for r in clusters.components(parts, touching.links(touching.nodes(parts))).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_query_lists_no_pairs(spark, sf, monkeypatch, name):
    real = overlap.overlap_pairs
    monkeypatch.setattr(overlap, "overlap_pairs", lambda parts: real(parts).filter(F.raise_error(F.concat(F.lit("a pair is listed: "), "a")).isNull()))
    same(spark, sf, name, entry._Q[name], entry._SQL[name])


def test_tiles_of_one_hash_are_put_apart(spark):
    rows = odd("lattice")
    parts = particles.derive(spark.createDataFrame(rows, SCHEMA))
    _, inside, roots = brute(rows)
    dealt = touching._dealt(parts).toArrow()
    assert len(dealt.group_by(touching.KEY).aggregate([])) > 3
    mixed = dealt.take(random.Random(1).sample(range(len(dealt)), len(dealt)))
    mixed = mixed.set_column(0, "tile", pa.array([7] * len(mixed)))
    told = [r for b in touching._worked(iter(mixed.to_batches(max_chunksize=100))) for r in b.to_pylist()]
    assert {(r["ds_id"], r["ID"]) for r in told if r["idj"]} == inside
    again = spark.createDataFrame([(r["ds_id"], r["ID"], r["root"], r["idj"]) for r in told], "ds_id string, ID long, root long, idj boolean")
    assert {(r.ds_id, r.ID): r.agl for r in clusters.components(parts, touching.links(again)).collect()} == roots


@pytest.mark.parametrize("sets", [0, 10_000])
def test_many_data_sets_are_joined_and_few_broadcast(spark, monkeypatch, sets):
    monkeypatch.setattr(touching, "SETS", sets)
    rows = [(str(k), *r[1:]) for k in range(3) for r in odd("made")[k:]]
    parts = particles.derive(spark.createDataFrame(rows, SCHEMA).dropDuplicates(["ds_id", "ID"]))
    rows = [(r.ds_id, r.ID, r.X, r.Y, r.D) for r in parts.collect()]
    dealt = touching._dealt(parts)
    assert ("ResolvedHint" in dealt._jdf.queryExecution().analyzed().toString()) == bool(sets)
    _, inside, roots = brute(rows)
    nodes = touching.nodes(parts).cache()
    assert {(r.ds_id, r.ID) for r in nodes.filter("idj").collect()} == inside
    assert {(r.ds_id, r.ID): r.agl for r in clusters.components(parts, touching.links(nodes)).collect()} == roots


#: Queries that need no contained circles.
WITHOUT_INSIDE = ["member_d_ratio", "particle_colours", "pooled_summary", "agglomerate_members", "agl_psd", "classify_agglomerates", "drawn_circles"]


@pytest.mark.parametrize("name", WITHOUT_INSIDE)
def test_query_looks_for_no_contained_circles(spark, sf, monkeypatch, name):
    seen = []
    real = touching.nodes
    monkeypatch.setattr(touching, "nodes", lambda parts, inside=True: seen.append(inside) or real(parts, inside))
    same(spark, sf, name, entry._Q[name], entry._SQL[name])
    assert seen == [False]


def test_nodes_without_contained_circles_have_the_same_links(spark):
    rows = odd("lattice")
    parts = particles.derive(spark.createDataFrame(rows, SCHEMA))
    nodes = touching.nodes(parts, inside=False).cache()
    assert nodes.filter("idj is not null or ID = root").count() == 0
    assert {(r.ds_id, r.ID): r.agl for r in clusters.components(parts, touching.links(nodes)).collect()} == brute(rows)[2]


#: Queries that need no centres of mass, which two more windows would make.
WITHOUT_CENTRES = ["particle_colours", "pooled_summary", "agglomerate_dsom", "agl_psd", "agl_psd_dsom", "classify_agglomerates"]


@pytest.mark.parametrize("name", WITHOUT_CENTRES)
def test_query_makes_no_centres(spark, sf, monkeypatch, name):
    real = morphology.agglomerates
    poisoned = lambda m, *a: real(m.withColumn("X", F.when(F.raise_error(F.concat(F.lit("a centre is made: "), "ID")).isNull(), F.col("X"))), *a)
    monkeypatch.setattr(morphology, "agglomerates", poisoned)
    same(spark, sf, name, entry._Q[name], entry._SQL[name])


def test_pooled_summary_ranks_once(spark, sf, monkeypatch):
    seen = []
    real = summary.quantiles
    monkeypatch.setattr(summary, "quantiles", lambda rows, by, asked: seen.append(by) or real(rows, by, asked))
    same(spark, sf, "pooled_summary", entry._Q["pooled_summary"], entry._SQL["pooled_summary"])
    assert seen == [[]]


def test_drawn_circles_number_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(morphology, "numbered", None)
    same(spark, sf, "drawn_circles", entry._Q["drawn_circles"], entry._SQL["drawn_circles"])


def test_pooled_summary_ranks_by_a_short_plan(spark, sf, monkeypatch):
    """The steps of the ranks repeat the plan of what they rank, which must not hold that of agglomerates."""
    seen = []
    real = summary.quantiles
    monkeypatch.setattr(summary, "quantiles", lambda rows, by, asked: seen.append(rows._jdf.queryExecution().withCachedData().toString()) or real(rows, by, asked))
    entry._Q["pooled_summary"](spark, sf)
    assert seen and not any("MapInArrow" in plan for plan in seen)
