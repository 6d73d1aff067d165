"""Stored tracks, levels, pruned reads, wide windows, intervals of mixed lengths, and the jobs on several tracks."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackengine.config import SessionConfig
from trackengine.functions import distributions as D
from trackengine.operators import hmm as H
from trackengine.operators import intervals as I
from trackengine.operators import track as T
from trackengine.operators import windows as W
from trackengine.plans import commands, plugins
from trackengine.sources import stored
from trackengine.sources.work import shared_folder

from .test_models import by_sequence, track_of


def same(a: T.Track, b: T.Track):
    left, right = by_sequence(a.df), by_sequence(b.df)
    assert left.keys() == right.keys()
    for s in left:
        assert np.array(left[s], float) == pytest.approx(np.array(right[s], float), nan_ok=True)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rng = random.Random(8)
    track = track_of(spark, {"1": [rng.randint(0, 99) for _ in range(53)], "02": [math.nan, 1.5, 2.5, -3.0, 9.0], "x": [7.0]}, 10)
    path = str(tmp_path_factory.mktemp("tracks") / "t")
    stored.write_track(track.df, path, track.genome, 10, zoom_levels=(60, 20, 120, 50))
    return track, path


def test_levels_are_made_of_finer_ones(spark, saved):
    track, path = saved
    assert stored.stored_levels(spark, path) == [2, 5, 6, 12]
    same(stored.open_track(spark, path), track)
    for factor, summary in ((2, "mean"), (4, "max"), (6, "min"), (12, "mean"), (24, "discrete mean"), (7, "mean"), (10, "mean")):
        for overlap in (0, 1):
            same(stored.read_zoomed(spark, path, factor * 10, summary, overlap), T.rebin(track, factor, summary, overlap))
    same(stored.read_zoomed(spark, path, 60, names=["1"]), T.rebin(track.filter_genome(["1"]), 6))
    total = {(r.seqname, r.bin): (r.total, r.n) for r in stored.read_level(spark, path, 12).collect()}
    values = by_sequence(track.df)["1"]
    assert total["1", 0] == (sum(values[:12]), 12) and total["1", 4] == (sum(values[48:]), 5)
    for bad in (25, 5):
        with pytest.raises(ValueError):
            stored.read_zoomed(spark, path, bad)
    with pytest.raises(ValueError, match="multiples"):
        stored.write_track(track.df, path + "-bad", track.genome, 10, zoom_levels=(25,))
    with pytest.raises(ValueError, match="unknown bin summary"):
        stored.read_zoomed(spark, path, 20, "median")


def test_levels_are_what_a_width_is_read_from(spark, saved):
    _, path = saved
    plan = lambda width: stored.read_zoomed(spark, path, width).df._jdf.queryExecution().toString()
    assert "bins=12" in plan(240) and "bins=6" in plan(180) and "bins=5" in plan(50) and "_zoom" not in plan(70)


def files_read(df) -> int:
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_regions_open_the_folders_they_touch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "STRETCH", 10)
    track = track_of(spark, {"a": range(100), "b": range(35)}, 5)
    stored.write_track(track.df.coalesce(1), str(tmp_path / "t"), track.genome, 5)
    regions = spark.createDataFrame([(1, "a", 52, 61), (2, "a", 495, 600), (3, "c", 0, 50), (4, "b", 49, 51), (5, "b", 9, 9)], "region_id int, seqname string, from int, to int")
    part, whole = stored.read_regions(spark, str(tmp_path / "t"), regions), stored.open_track(spark, str(tmp_path / "t"))
    # bins 10 to 12 and 99 of a, 9 and 10 of b: four folders of fourteen, each of one file or, where ranges were cut, two
    few, all_ = files_read(part.df), files_read(whole.df)
    assert all_ >= 14 and few <= all_ - 8 and few <= 8
    vectors = lambda t: {r.region_id: r.v for r in T.region_vectors(t, regions).collect()}
    assert vectors(part) == vectors(whole) == vectors(track) == {1: [10.0, 11.0, 12.0], 2: [99.0], 4: [9.0, 10.0]}
    monkeypatch.setattr(stored, "FOLDERS", 2)
    assert vectors(stored.read_regions(spark, str(tmp_path / "t"), regions)) == vectors(track)
    assert stored.read_regions(spark, str(tmp_path / "t"), regions.filter("false")).df.count() == 0


def test_shared_tables_are_not_joined(spark):
    table = spark.createDataFrame([("s", i, float(i), float(i % 3)) for i in range(9)], "seqname string, bin int, x double, y double")
    genome = spark.createDataFrame([("s", 9)], "seqname string, nbins int")
    x, y = T.tracks_of(table, ["x", "y"], genome)
    both = T.combine([x.map(lambda v: v * 2), y.map_positions(lambda s, p, v: v + p)], lambda a, b: a - b)
    assert by_sequence(both.df) == {"s": [2.0 * i - (i % 3) - i for i in range(9)]}
    assert "Join" not in both.df._jdf.queryExecution().toString()
    other = W.classify(x, 3, lambda w: F.get(w, F.lit(0)))
    assert other.shared is None and x.filter_genome(["s"]).shared is None
    assert by_sequence(T.combine([other, y], lambda a, b: a + b).df)["s"][1:8] == [i - 1 + i % 3 for i in range(1, 8)]


@pytest.mark.parametrize("n,block", [(1, 5), (2, 3), (5, 7), (30, 10), (60, 1000), (61, 4)])
def test_wide_windows_equal_lists(spark, n, block):
    rng = random.Random(n)
    data = {"a": [rng.choice([rng.uniform(-5, 5)] * 12 + [math.nan]) for _ in range(75)], "b": [rng.choice([1.0, 2.0, math.inf, -math.inf]) if rng.random() < 0.1 else rng.random() for _ in range(80)], "c": [1.0]}
    track, left, right = track_of(spark, data), n // 2, (n - 1) // 2
    plain = {"sum": sum, "mean": lambda w: sum(w) / len(w), "max": max, "min": min}
    for what, f in plain.items():
        got = by_sequence(W.classify_wide(track, n, what, block=block).df)
        for s, values in data.items():
            for i, v in enumerate(got[s]):
                w = values[max(0, i - left) : i + right + 1]
                if len(w) < n or i - left < 0 or any(map(math.isnan, w)):
                    assert math.isnan(v)
                else:
                    assert v == pytest.approx(f(w), nan_ok=True, abs=1e-9)
    doubled = by_sequence(W.classify_wide(track, n, "sum", lambda v: v * 2, block).df)["a"]
    single = by_sequence(W.classify_wide(track, n, "sum", block=block).df)["a"]
    assert doubled == pytest.approx([2 * v for v in single], nan_ok=True)
    with pytest.raises(ValueError):
        W.classify_wide(track, 0, "sum")
    with pytest.raises(ValueError):
        W.classify_wide(track, 3, "median")


@pytest.mark.parametrize("piece,levels", [(4, 3), (2, 1), (64, 2), (1, 5)])
def test_intervals_of_all_lengths(spark, piece, levels):
    rng = random.Random(piece)

    def draw(n):
        out = []
        for i in range(n):
            start, length = rng.randint(-500, 5000), rng.choice([0, 1, 3, 40, 300, 4000])
            out.append((i, rng.choice("st"), start, start + length, float(rng.randint(0, 5))))
        return out

    a, b = draw(70), draw(60)
    schema = "id int, seqname string, from int, to int, test double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    meets = lambda x, y: x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]
    got = sorted((r.a_id, r.b_id) for r in I.overlaps(da, db, piece, levels).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if meets(x, y))
    left = sorted(r.id for r in I.without_overlapped(da, F.col("test"), ["id"], piece, levels).collect())
    assert left == sorted(x[0] for x in a if not any(x[0] != y[0] and meets(x, y) and y[4] >= x[4] for y in a))


@pytest.mark.parametrize("block", [7, 1000, I.BLOCK])
def test_shared_positions_equal_brute_force(spark, block):
    rng = random.Random(block)
    draw = lambda n: [(i, rng.choice(["s", "t", None]), x, x + rng.choice([0, 1, 3, 40, 300, 4000])) for i in range(n) for x in [rng.randint(-500, 3000)]]
    a, b = [*draw(80), (80, "s", 9000, 9001)], draw(70) + [(99, "s", 10, 13)] * 9
    schema = "id int, seqname string, from int, to int"
    got = {r.id: (r.n, r.shared) for r in I.shared(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), block).collect()}
    want = {}
    for i, name, low, high in a:
        if name and low < high:
            parts = [min(high, y) - max(low, x) for _, other, x, y in b if other == name and x < y and x < high and low < y]
            want[i] = (len(parts), sum(parts))
    assert got == want and want[80] == (0, 0)


def test_shared_positions_without_pairs(spark):
    """2.5 thousand million pairs, on a few positions."""
    some = spark.range(50_000).select("id", F.lit("s").alias("seqname"), (F.col("id") % 5).cast("int").alias("from"), (F.col("id") % 5 + 10).cast("int").alias("to"))
    assert {tuple(r) for r in I.shared(some, some).groupBy("from").agg(F.min("n"), F.max("n"), F.min("shared"), F.max("shared")).collect()} == {
        (x, 50_000, 50_000, shared, shared) for x in range(5) for shared in [10_000 * sum(10 - abs(x - y) for y in range(5))]
    }


def test_pairs_of_one_table_and_what_is_shuffled_for_them(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 60), rng.choice("st"), x, x + rng.choice([0, 1, 5, 90, 700])) for _ in range(80) for x in [rng.randint(-50, 900)]] + [(7, "s", 5, 9), (8, "s", 5, 9), (8, "s", 5, 9)]
    df = spark.createDataFrame(rows, "id int, seqname string, from int, to int")
    want = sorted((*x, *y) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    for piece, levels in ((8, 3), (64, 1), (1, 4)):
        assert sorted(map(tuple, I.overlapping_pairs(df, "id", piece, levels).collect())) == want
    short = spark.range(1000).selectExpr("id", "'s' AS seqname", "CAST(id * 8 AS int) AS `from`", "CAST(id * 8 + 4 AS int) AS `to`")
    spans, points, _ = I._sides(short, short, ("x", "y"), 8, 3)  # one level is there, of three
    assert spans.count() == points.count() == 1000


def test_a_long_interval_is_a_few_rows(spark):
    df = spark.createDataFrame([("s", 0, 250_000_000), ("s", 7, 8), ("s", 4000, 4200)], "seqname string, from int, to int")
    assert {r["to"]: r["count"] for r in I._pieces(df, I.PIECE, I.LEVELS).groupBy("to").count().collect()} == {250_000_000: 15, 8: 3, 4200: 4}


def test_rows_can_be_removed(spark):
    df = spark.createDataFrame([("s", 1, 2), ("s", 3, 4), ("t", 1, 2)], "seqname string, from int, to int")
    gone = spark.createDataFrame([("s", 1, "x"), ("s", 1, "y"), ("u", 9, "z")], "seqname string, from int, why string")
    assert sorted(map(tuple, I.remove(df, gone, ["seqname", "from"]).collect())) == [("s", 3, 4), ("t", 1, 2)]


def test_shared_folder(spark):
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:"
    assert a != b and a.startswith(base)


def run(*a):
    return plugins.main(["trackengine.plans.commands", *map(str, a)])


@pytest.fixture(scope="module")
def jobs(spark, tmp_path_factory):
    """Two aligned tracks with high bins at the same places, and a control whose are elsewhere."""
    folder, rng = tmp_path_factory.mktemp("jobs"), np.random.default_rng(3)
    for name, phase in (("one", 0), ("two", 0), ("control", 25)):
        track = track_of(spark, {s: [float(rng.poisson(3) if i % 50 != phase else 60) for i in range(300)] for s in ("a", "b", "c")})
        stored.write_track(track.df, str(folder / name), track.genome)
    return folder


def test_treatment_against_control_as_a_job(jobs):
    run("LearnModel", "treatment", jobs / "t.json", jobs / "one", "a", "b")
    run("LearnModel", "--tries=3", "control", jobs / "c.json", jobs / "control")
    common = [f"--model={jobs}/t.json", f"--model-control={jobs}/c.json", "--components=2,3", "--components-control=7,8", "--threshold=0.5"]
    against_own = {(r.seqname, r["from"]) for r in run("CallPeaks", *common, jobs / "o1", jobs / "one", jobs / "one").collect()}
    against_other = {(r.seqname, r["from"]) for r in run("CallPeaks", *common, jobs / "o2", jobs / "one", jobs / "control").collect()}
    assert {(s, i) for s in "abc" for i in (50, 100, 250)} <= against_other
    assert not {(s, i) for s in "abc" for i in (50, 100, 250)} & against_own
    with pytest.raises(FileNotFoundError, match="nowhere"):
        run("CallPeaks", *common, jobs / "o3", jobs / "one", jobs / "nowhere")


def test_models_of_several_tracks_as_jobs(jobs):
    models = run("LearnModels", "--sequences=a,b", "treatment", jobs / "m.json", jobs / "one", jobs / "two")
    assert len(models) == 2 and len(json.loads((jobs / "m.json").read_text())) == 2
    found = run("CallJointPeaks", f"--models={jobs}/m.json", "--components=2,3", "--threshold=0.9", jobs / "one", jobs / "two").collect()
    assert {(r.seqname, r["from"]) for r in found} >= {(s, i) for s in "abc" for i in (0, 50, 250)}
    start = D.Distribution("vector:mixture distribution", (0.9, 0.1), (D.product([D.poisson(2.0)] * 2), D.product([D.poisson(40.0)] * 2)))
    (jobs / "start.json").write_text(json.dumps(start.to_json()))
    joint = run("LearnJointModel", "--sequences=a", jobs / "start.json", jobs / "j.json", jobs / "one", jobs / "two")
    assert joint.parameters == pytest.approx((0.98, 0.02)) and commands.load_model(str(jobs / "j.json")).parts[1].parts[0].parameters[0] == pytest.approx(60)
    score = run("ScoreJointModel", "--components=1", jobs / "j.json", jobs / "s", jobs / "one", jobs / "two")
    values = by_sequence(score.df)
    assert {s: [i for i, v in enumerate(x) if v > 0.5] for s, x in values.items()} == {s: list(range(0, 300, 50)) for s in "abc"}
    (jobs / "bad.json").write_text(json.dumps(D.mixture([1.0], [D.translation(D.Distribution("scalar:none", ()), 1.0)]).to_json()))
    with pytest.raises(ValueError, match="unknown distributions"):
        commands.load_model(str(jobs / "bad.json"))


def test_paths_and_regions_as_jobs(spark, jobs):
    model = H.Hmm(np.array([0.9, 0.1]), np.array([[0.9, 0.1], [0.9, 0.1]]), (D.poisson(3.0), D.poisson(60.0)), ("low", "high"))
    (jobs / "hmm.json").write_text("# two states\n" + json.dumps(model.to_json()))
    assert by_sequence(run("StatePath", jobs / "hmm.json", jobs / "one", "b"), "state") == {"b": [int(i % 50 == 0) for i in range(300)]}
    post = by_sequence(run("StatePath", "--posterior", jobs / "hmm.json", jobs / "one", "b"), "p")["b"]
    assert all((p[1] > 0.5) == (i % 50 == 0) for i, p in enumerate(post))
    (jobs / "r.bed").write_text("a\t49\t52\nb\t298\t305\n")
    got = {r.region: r.v for r in run("RegionVectors", jobs / "one", jobs / "r.bed").collect()}
    whole = by_sequence(stored.open_track(spark, str(jobs / "one")).df)
    assert got == {"a:49-52": whole["a"][49:52], "b:298-305": whole["b"][298:]}


def test_jobs_keep_zoom_levels(spark, jobs, tmp_path):
    settings = tmp_path / "config.json"
    settings.write_text('{"BigWig Zoom Levels": [10, 100]}')
    run("LearnModel", "treatment", jobs / "t2.json", jobs / "one", "a")
    config = SessionConfig().merged(settings.read_text())
    commands.CallPeaks(config, [f"--model={jobs}/t2.json", "--components=2,3", str(tmp_path / "o"), str(jobs / "one")]).collect()
    assert stored.stored_levels(spark, str(tmp_path / "o")) == [10, 100]
    ten = commands.read_track(SessionConfig(bin_size=50, bin_summary="max"), str(tmp_path / "o"))
    same(ten, T.rebin(stored.open_track(spark, str(tmp_path / "o")), 50, "max"))
