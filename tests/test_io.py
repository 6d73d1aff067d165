"""Text formats, settings, plugins, streaming bins."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from trackengine.config import SessionConfig, parse_json
from trackengine.operators import segmentation as Z
from trackengine.plans import plugins
from trackengine.sources import bed
from trackengine.streaming.binning import stream_bins

from .conftest import SMALL


@pytest.mark.parametrize("compress", [False, True])
def test_bed9_round_trip(spark, tmp_path, compress):
    rows = spark.createDataFrame([("s", 0, 20, 1), ("s", 20, 50, 0), ("t", 0, 5, 2)], "seqname string, from int, to int, state int")
    out = Z.bed9(rows, names=["x", "y", "z"])
    bed.write_bed9(out, str(tmp_path / "o"), "n", "d", compress)
    first = spark.read.text(str(tmp_path / "o")).filter(F.col("value").startswith("track name=")).count()
    back = bed.read_bed9(spark, str(tmp_path / "o"))
    assert first == 1 and sorted(map(tuple, back.drop("line").collect())) == sorted(map(tuple, out.select(*bed.BED9).collect()))
    assert bed.read_bed3(spark, str(tmp_path / "o")).count() == 3
    with pytest.raises(ValueError):
        Z.bed9(rows, names=["x"], n=3)


def test_bedgraph(spark, tmp_path):
    (tmp_path / "a.bedgraph").write_text("track type=bedGraph\ns\t0\t25\t1.5\ns\t25\t30\t4\n")
    signal = bed.bedgraph_signal(bed.read_bedgraph(spark, str(tmp_path)), 10)
    assert sorted(map(tuple, signal.collect())) == [("s", 0, 1.5), ("s", 10, 1.5), ("s", 20, 1.5), ("s", 20, 4.0)]


def test_track_files_prune(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "seqname string, bin int, value double")
    bed.write_track(df, str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).filter("seqname = 'a'")
    assert read.count() == 1 and len(read.inputFiles()) >= 1
    assert bed.is_gzip(b"\x1f\x8b\x08") and not bed.is_gzip(b"BED")


def test_config():
    c = SessionConfig().merged('{"Threads": 20, # many\n "Bin Size": 500,\n"Bin Summary Statistics": "discrete mean"}')
    assert (c.threads, c.bin_size, c.bin_summary) == (20, 500, "discrete mean")
    assert SessionConfig().merged(c.to_json()) == c
    with pytest.raises(ValueError):
        parse_json('{"a": "x#y"}')


def test_plugins(tmp_path):
    module = types.ModuleType("a_plugin")
    module.one = lambda config, *args: (config.bin_size, args)
    module.two = lambda args: args
    module.three = lambda: "none"
    module.four = lambda config: config.threads
    sys.modules["a_plugin"] = module
    assert plugins.main(["--bin-size", "7", "a_plugin", "one", "x", "y"]) == (7, ("x", "y"))
    assert plugins.main(["a_plugin", "two", "x", "y"]) == ["x", "y"] and plugins.main(["a_plugin", "three"]) == "none"
    (tmp_path / "c.json").write_text('{"Threads": 3, "Bin Size": 9}')
    module.CONFIG_FILENAME = str(tmp_path / "c.json")
    assert plugins.main(["--threads", "5", "a_plugin", "four"]) == 3  # the plugin's own file comes after the flags


def test_stream_bins_equal_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    bins = stream_bins(stream, "ts", F.col("event_type"), F.col("value"))
    q = bins.writeStream.outputMode("append").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.seqname, r.start): (r.n, r.high) for r in spark.table("bins").collect()}
    hour = F.date_trunc("hour", "ts").alias("start")
    want = {(r.event_type, r.start): (r.n, r.high) for r in source.groupBy("event_type", hour).agg(F.count("*").alias("n"), F.max("value").alias("high")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_commands(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(s, i, float(rng.poisson(3) if i % 50 else 90)) for s in ("a", "b") for i in range(400)]
    bed.write_track(spark.createDataFrame(rows, "seqname string, bin int, value double"), str(tmp_path / "t"))
    run = lambda *a: plugins.main(["trackengine.plans.commands", *map(str, a)])
    model = run("LearnModel", "treatment", tmp_path / "m.json", tmp_path / "t", "a", "b")
    assert sum(model.parameters) == pytest.approx(1) and (tmp_path / "m.json").exists()
    found = run("CallPeaks", f"--model={tmp_path}/m.json", "--components=2,3", "--threshold=0.9", tmp_path / "o", tmp_path / "t").collect()
    assert {r["from"] for r in found if r["seqname"] == "a"} >= {50, 100, 350}
    doc = run("Estimate", 4, tmp_path / "t", tmp_path / "d.json", "a")
    assert len(doc["Parameters"]["X"]) == 4
