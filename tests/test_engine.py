"""Particles, overlap, components, morphology: against brute force on generated circles, and invariances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulo.errors import AgglomerateError, UnknownIdError
from granulo.operators import clusters, drawing, histogram, morphology, overlap, particles, quantiles, summary

SCHEMA = "ds_id string, ID long, X double, Y double, D double"


def made(seed=0, n=120, sets=3, size=140, giant=False):
    r = random.Random(seed)
    rows = [(f"s{k}", i, r.uniform(0, size), r.uniform(0, size), float(r.randint(1, 25))) for k in range(sets) for i in range(n)]
    rows += [("s0", 900, 10.0, 10.0, 8.0), ("s0", 901, 10.0, 10.0, 8.0), ("s0", 902, 300.0, 0.0, 10.0), ("s0", 903, 310.0, 0.0, 10.0), ("s0", 904, 500.0, 0.0, 20.0), ("s0", 905, 505.0, 0.0, 10.0), ("one", 1, 0.0, 0.0, 3.0), ("flat", 1, 0.0, 0.0, 0.0), ("flat", 2, 0.0, 0.0, 0.0)]
    if giant:
        rows.append(("s1", 999, 70.0, 70.0, 120.0))
    return rows


def brute(rows):
    pairs, inside, by = {}, set(), {}
    for ds, i, x, y, d in rows:
        by.setdefault(ds, []).append((i, x, y, d))
    for ds, mine in by.items():
        for k, (i, x, y, d) in enumerate(mine):
            for j, p, q, e in mine[k + 1 :]:
                dist = math.sqrt((x - p) ** 2 + (y - q) ** 2)
                if dist <= (d + e) / 2:
                    pairs[ds, min(i, j), max(i, j)] = dist
                    if dist <= (d - e) / 2:
                        inside.add((ds, j))
                    if dist <= (e - d) / 2:
                        inside.add((ds, i))
    root = {(ds, r[0]): r[0] for ds, m in by.items() for r in m}

    def find(ds, i):
        while root[ds, i] != i:
            i = root[ds, i]
        return i

    for ds, i, j in pairs:
        a, b = find(ds, i), find(ds, j)
        root[ds, max(a, b)] = min(a, b)
    return pairs, inside, {k: find(*k) for k in root}


@pytest.mark.parametrize("giant", [False, True])
def test_overlap_and_components_match_brute_force(spark, giant):
    rows = made(1, giant=giant)
    parts = particles.derive(spark.createDataFrame(rows, SCHEMA)).cache()
    pairs = overlap.overlap_pairs(parts).cache()
    want, inside, roots = brute(rows)
    got = {(r.ds_id, min(r.a, r.b), max(r.a, r.b)): r.dist for r in pairs.collect()}
    assert pairs.count() == len(want) and got.keys() == want.keys()
    assert {(r.ds_id, r.ID) for r in overlap.contained(pairs).collect()} == inside
    for method in ("grouped", "distributed", "auto"):
        assert {(r.ds_id, r.ID): r.agl for r in clusters.components(parts, pairs, method).collect()} == roots
    few = clusters.components(parts, pairs, "auto", grouped_pairs=50)
    assert {(r.ds_id, r.ID): r.agl for r in few.collect()} == roots


def test_tangent_concentric_and_long_chain(spark):
    rows = made()
    want, inside, _ = brute(rows)
    assert ("s0", 902, 903) in want and ("s0", 905) in inside and {("s0", 900), ("s0", 901)} <= inside
    chain = spark.createDataFrame([("c", i, i * 1.0, 0.0, 1.0) for i in range(1500)], SCHEMA)
    pairs = overlap.overlap_pairs(chain)
    for method in ("grouped", "distributed"):
        assert clusters.components(chain, pairs, method).select("agl").distinct().count() == 1


def full(spark, rows, threshold=0.5):
    parts = particles.derive(spark.createDataFrame(rows, SCHEMA))
    pairs = overlap.overlap_pairs(parts)
    members = morphology.membership(overlap.flag_contained(parts, pairs), clusters.components(parts, pairs, "grouped")).cache()
    return parts, members, morphology.numbered(morphology.agglomerates(members, threshold)).cache()


def test_agglomerates_partition_particles_and_scale(spark):
    rows = made(2)
    parts, members, aggl = full(spark, rows)
    assert aggl.agg(F.sum("members_count")).first()[0] == len(rows)
    assert sorted(r.ID for r in aggl.select("ID").collect()) == list(range(1, aggl.count() + 1))
    _, _, twice = full(spark, [(a, i, 3 * x + 7, 3 * y - 5, 3 * d) for a, i, x, y, d in rows])
    key = lambda df, k: {(r.ds_id, r.agl): (r.members_count, r.type, round((r.Rg or 0) / k, 6), round(r.D / k, 6)) for r in df.collect()}
    assert key(aggl, 1) == key(twice, 3)
    kinds = {r.type for r in morphology.classify_particles(members, aggl).select("type").distinct().collect()}
    assert kinds <= {"separate", "similar", "collector", "attached2coll"}


def test_morphology_of_a_pair_by_hand(spark):
    _, members, aggl = full(spark, [("a", 1, 0.0, 0.0, 20.0), ("a", 2, 12.0, 0.0, 10.0)])
    r = aggl.first()
    v = math.pi / 6 * (20**3 + 10**3)
    assert (r.type, r.members_count, r.idj_members_count) == ("collector", 2, 0)  # a ratio at the threshold
    assert r.volume == pytest.approx(v) and r.D == pytest.approx((6 * v / math.pi) ** (1 / 3))
    assert r.X_com == pytest.approx(12 * 100 / 500) and r.Rg == pytest.approx(math.sqrt((400 * 2.4**2 + 100 * 9.6**2) / 500))
    assert r.members_Dmean == 15 and r.members_Dstdev == pytest.approx(math.sqrt(50))
    assert {m.ID: m.D_ratio for m in members.collect()} == {1: 1.0, 2: 0.5}
    assert morphology.member(members, "a", 1, 2).first().D == 10
    with pytest.raises(AgglomerateError):
        morphology.member(members, "a", 1, 3)
    assert full(spark, [("a", 1, 0.0, 0.0, 20.0), ("a", 2, 12.0, 0.0, 10.0)], 0.49)[2].first().type == "similar"


def test_singletons_only(spark):
    parts, _, aggl = full(spark, [("a", 1, 0.0, 0.0, 2.0), ("a", 2, 50.0, 0.0, 2.0)])
    s = summary.dataset_summary(parts, aggl).first()
    assert (s.N_agl, s.Ra, s.n_ppA_mean, s.sep2agl, s.ER) == (0, 0.0, None, None, 0.0)
    assert s.N_ppA + s.N_pp1 == s.N_primary_particle
    assert {r.metric: r.value for r in summary.pooled_summary(parts, aggl).collect()}["N_aerosol_particle"] == 2


def test_duplicates_scale_and_lookup(spark):
    src = spark.createDataFrame([("a", 1, 0.0, 0.0, 5.0), ("a", 1, 9.0, 9.0, 2.0), ("a", 2, 1.0, 2.0, 4.0), ("b", 1, 0.0, 0.0, 1.0)], "ds_id string, ID long, X double, Y double, R double")
    info = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "ds_id string, px_size double")
    p = particles.particles(src, info)
    assert sorted((r.ID, r.X, r.D, r.name) for r in p.collect()) == [(1, 4.5, 2.0, "P1"), (2, 0.5, 4.0, "P2")]
    assert [r.ds_id for r in particles.missing_scale(particles.with_diameter(src), info).collect()] == ["b"]
    assert sorted(r.ID for r in particles.particles(src, None, "reassign").filter("ds_id = 'a'").collect()) == [0, 1, 2]
    assert [r.ID for r in particles.by_ids(p, [2, 1]).collect()] == [2, 1]
    with pytest.raises(UnknownIdError, match="7"):
        particles.by_ids(p, [2, 7])


def test_quantiles_match_numpy(spark):
    r = random.Random(4)
    rows = [(k, v) for k in "abc" for v in [r.choice([r.uniform(0, 1), r.uniform(0, 1000), 5.0, -3.0]) for _ in range(r.randint(1, 300))]] + [("one", 2.5), ("none", None), ("far", 1e300), ("far", 0.0), ("far", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    asked = {f"q{p}": ("v", p) for p in (0.0, 0.1, 0.5, 0.93, 1.0)}
    got = {x.g: x for x in quantiles.quantiles(df, ["g"], asked).collect()}
    for g in ("a", "b", "c", "one", "far"):
        mine = [v for k, v in rows if k == g]
        for name, (_, p) in asked.items():
            assert got[g][name] == pytest.approx(np.quantile(mine, p)), (g, p)
    pooled = quantiles.quantiles(df, [], asked).first()
    assert pooled["q0.93"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.93))
    assert quantiles.quantiles(df.limit(0), [], asked).first()["q0.5"] is None


def test_bins_close_on_the_right(spark):
    v = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 9.0, -1.0)], "D double")
    d = histogram.distribution(v, "D", [0.0, 1.0, 2.0, 3.0]).collect()
    assert [r.counts for r in d] == [2, 2, 1] and d[-1].cummulative_norm == pytest.approx(1) and d[-1].volume_cummulative_norm == pytest.approx(1)
    assert [r.counts for r in histogram.distribution(v, "D", [20.0, 21.0]).collect()] == [0]
    assert histogram.bin_edges(0, 10, 3, step=True) == [0, 3, 6, 9, 12] and histogram.bin_edges(1, 100, 2, log=True) == [1, 10, 100]
    with pytest.raises(ValueError):
        histogram.bin_edges(0, 1, log=True)
    assert histogram.parse_edges("[1, 2, 4]", 0, 1) == [1, 2, 4] and len(histogram.parse_edges("5", 0, 10)) == 6
    assert histogram.labels([0.0, 2e-6, 4e-6], "pandas")[0][0] < 0
    assert histogram.auto_edges(v.filter("D > 0"))[0] == 1.0


def test_pictures(spark):
    from xml.etree import ElementTree

    rows = [("a", 1, 10.0, 10.0, 8.0, "collector"), ("a", 2, 12.0, 10.0, 2.0, "attached2coll"), ("b", 1, 5.5, 5.0, 3.0, None)]
    c = spark.createDataFrame(rows, "ds_id string, ID long, X double, Y double, D double, type string")
    ns = "{http://www.w3.org/2000/svg}"
    got = {r.ds_id: ElementTree.fromstring(r.svg) for r in drawing.overlay(c, drawing.colour_by_type()).collect()}
    assert [(x.get("r"), x.get("fill"), x.get("fill-opacity")) for x in got["a"].iter(f"{ns}circle")] == [("4.0", "blue", "0.2"), ("1.0", "blue", "0.2")]
    assert [x.text for x in got["a"].iter(f"{ns}text")] == ["1", "2"] and got["a"].get("viewBox") == "0 0 14 14" and next(got["b"].iter(f"{ns}circle")).get("fill") == "black"
    size = spark.createDataFrame([("a", 640, 480)], "ds_id string, width long, height long")
    for levels, middle in ((None, "#ff0000"), (2, "#ff0000")):
        by = {r.ds_id: ElementTree.fromstring(r.svg) for r in drawing.overlay(c, drawing.colour_by("D", levels=levels), labels=False, size=size).collect()}
        assert [x.get("fill") for x in by["a"].iter(f"{ns}circle")] == [middle, "#0000ff"] and by["a"].get("viewBox") == "0 0 640 480" and not list(by["a"].iter(f"{ns}text"))
    d = histogram.distribution(c, "D", [0.0, 4.0, 8.0])
    plot = ElementTree.fromstring(drawing.plot_distribution(d, norm=True))
    assert [float(x.get("height")) for x in plot.iter(f"{ns}rect")] == [400.0, 200.0] and next(plot.iter(f"{ns}polyline")).get("points").endswith("600.0,0.0")
    assert len(list(ElementTree.fromstring(drawing.plot_distribution(d, step=True)).iter(f"{ns}polyline"))) == 2


def test_empty_particles(spark):
    parts, members, aggl = full(spark, [])
    assert aggl.count() == 0 and members.count() == 0 and summary.dataset_summary(parts, aggl).count() == 0


def test_append_members_and_log(spark, tmp_path):
    from granulo import log

    a = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "ds_id string, ID long, agl long")
    assert morphology.append_members(a, a.limit(1).unionByName(spark.createDataFrame([("a", 3, 1)], a.schema))).count() == 3
    for _ in range(2):
        log.set_up(str(tmp_path / "x.log")).info("once")
    assert (tmp_path / "x.log").read_text().count("once") == 2 and len(log.set_up().handlers) == 1
