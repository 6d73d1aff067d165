"""Plugin functions: learn a model from a track's files, estimate a density, call peaks.

Tracks are Parquet folders (seqname, bin, value) as write_track() makes them. Options are --name=value; other arguments are
places. Run as `python -m trackengine.plans.plugins trackengine.plans.commands LearnModel treatment model.json track/`.
"""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackengine.config import SessionConfig, dump_json, parse_json
from trackengine.functions.distributions import Distribution, unknown_names
from trackengine.operators import estimate, hmm
from trackengine.operators.peaks import joint_peaks
from trackengine.operators.track import KEYS, Track, region_vectors, require_aligned, wide
from trackengine.operators.windows import hopping
from trackengine.sources import stored
from trackengine.sources.bed import read_bed3

from . import peakcaller

#: Components (from 0) that are foreground by default.
FOREGROUND = {"treatment": [3], "control": [8]}
START = {"treatment": (peakcaller.treatment_start, 1e-8), "control": (peakcaller.control_start, 1e-6)}


def _session(config: SessionConfig) -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.master(f"local[{config.threads}]").getOrCreate()


def read_track(config: SessionConfig, path: str, names: list[str] | None = None) -> Track:
    """A stored track; sequences are chosen before files are read. A bin size makes bins of as many positions, from the coarsest
    stored level that divides it."""
    spark = _session(config)
    track = stored.open_track(spark, path, names, config.track_init)
    if config.bin_size in (0, track.bin_size) and not config.bin_overlap:
        return track
    return stored.read_zoomed(spark, path, config.bin_size or track.bin_size, config.bin_summary, config.bin_overlap, names, config.track_init)


def read_tracks(config: SessionConfig, paths: list[str], names: list[str] | None = None) -> list[Track]:
    """Several tracks. That all are there is looked up before any work starts."""
    jvm, conf = _session(config)._jvm, _session(config)._jsc.hadoopConfiguration()
    places = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    if missing := [p for p, at in zip(paths, places) if not at.getFileSystem(conf).exists(at)]:
        raise FileNotFoundError(f"no such tracks: {', '.join(missing)}")
    return [read_track(config, p, names) for p in paths]


def _split(args: list[str]) -> tuple[dict[str, str], list[str]]:
    options = dict(a[2:].split("=", 1) for a in args if a.startswith("--"))
    return options, [a for a in args if not a.startswith("--")]


def load_model(path: str) -> Distribution:
    model = Distribution.from_json(parse_json(Path(path).read_text()))
    if unknown := unknown_names(model):
        raise ValueError(f"unknown distributions: {sorted(unknown)}")
    return model


def LearnModel(config: SessionConfig, args: list[str]) -> Distribution:
    """[--tries=1] KIND MODEL.json TRACK [SEQUENCE …]: KIND is treatment or control, or a document of a start model.

    With several tries the best fit of as many seeded starts is taken."""
    options, (kind, out, path, *names) = _split(args)
    start, eps = (START[kind][0](), START[kind][1]) if kind in START else (load_model(kind), 1e-8)
    model = peakcaller.learn(read_track(config, path, names), start, eps, tries=int(options.get("tries", 1))).model
    Path(out).write_text(dump_json(model.to_json()))
    return model


def CallPeaks(config: SessionConfig, args: list[str]) -> DataFrame:
    """--model=M.json --model-control=C.json --components=3 --components-control=8 --threshold=0.95 OUT TRACK [CONTROL]."""
    options, (out, path, *control) = _split(args)
    parts = lambda name, default: [int(x) for x in options[name].split(",")] if name in options else default
    tracks = read_tracks(config, [path, *control])
    score = peakcaller.score(tracks[0], load_model(options["model"]), parts("components", FOREGROUND["treatment"]))
    if control:
        other = peakcaller.score(tracks[1], load_model(options["model-control"]), parts("components-control", FOREGROUND["control"]))
        score = peakcaller.treatment_against_control(score, other)
    return peakcaller.peaks(_saved(config, score, out), float(options.get("threshold", 0.95)), -1)


def _saved(config: SessionConfig, track: Track, path: str) -> Track:
    """A track written with the session's zoom levels, and read back."""
    stored.write_track(track.df, path, track.genome, track.bin_size, config.zoom_levels or ())
    return replace(stored.open_track(_session(config), path, init=track.init), genome=track.genome)


def _sequences(options: dict[str, str]) -> list[str] | None:
    return options["sequences"].split(",") if "sequences" in options else None


def LearnModels(config: SessionConfig, args: list[str]) -> list[Distribution]:
    """[--sequences=a,b] KIND OUT.json TRACK TRACK …: a model for each of several aligned tracks, as a list in one document."""
    options, (kind, out, *paths) = _split(args)
    start, eps = START[kind]
    tracks = read_tracks(config, paths, _sequences(options))
    require_aligned(tracks)
    models = [peakcaller.learn(t, start(), eps).model for t in tracks]
    Path(out).write_text(dump_json([m.to_json() for m in models]))
    return models


def CallJointPeaks(config: SessionConfig, args: list[str]) -> DataFrame:
    """--models=M.json --components=3 --threshold=0.95 TRACK TRACK …: peaks where all tracks' scores are above it."""
    options, paths = _split(args)
    tracks = read_tracks(config, paths)
    models = [Distribution.from_json(d) for d in parse_json(Path(options["models"]).read_text())]
    parts = [int(x) for x in options["components"].split(",")] if "components" in options else FOREGROUND["treatment"]
    scores = [peakcaller.score(t, m, parts) for t, m in zip(tracks, models, strict=True)]
    return joint_peaks(scores, [float(options.get("threshold", 0.95))] * len(scores), -1)


def LearnJointModel(config: SessionConfig, args: list[str]) -> Distribution:
    """[--sequences=a,b] [--eps=1e-6] START.json OUT.json TRACK TRACK …: one mixture of products for the tracks together.

    START has as many factors in each component as there are tracks."""
    options, (start, out, *paths) = _split(args)
    tracks = read_tracks(config, paths, _sequences(options))
    require_aligned(tracks)
    model = estimate.fit_joint(wide(tracks), load_model(start), eps=float(options.get("eps", 1e-6))).model
    Path(out).write_text(dump_json(model.to_json()))
    return model


def ScoreJointModel(config: SessionConfig, args: list[str]) -> Track:
    """[--sequences=a,b] --components=0,1 MODEL.json OUT TRACK TRACK …: for each bin the probability that the tracks' values
    come from the components, written as a track."""
    options, (model, out, *paths) = _split(args)
    tracks = read_tracks(config, paths, _sequences(options))
    require_aligned(tracks)
    rows = estimate.vector_posterior(wide(tracks), load_model(model), [int(x) for x in options["components"].split(",")])
    return _saved(config, replace(tracks[0], df=rows.select(*KEYS, F.exp("log_posterior").alias("value"))), out)


def StatePath(config: SessionConfig, args: list[str]) -> DataFrame:
    """[--posterior] HMM.json TRACK [SEQUENCE …]: the most probable state of each bin's sequence, or all states' posteriors."""
    flag, rest = "--posterior" in args, [a for a in args if a != "--posterior"]
    _, (document, path, *names) = _split(rest)
    model = hmm.Hmm.from_json(parse_json(Path(document).read_text()))
    return (hmm.posteriors if flag else hmm.paths)(read_track(config, path, names), model)


def RegionVectors(config: SessionConfig, args: list[str]) -> DataFrame:
    """TRACK REGIONS.bed: (region, v), the values of each region's bins; only folders that regions touch are read."""
    _, (path, bed) = _split(args)
    regions = read_bed3(_session(config), bed).withColumn("region", F.concat_ws(":", "seqname", F.concat_ws("-", "from", "to")))
    return region_vectors(stored.read_regions(_session(config), path, regions), regions.distinct(), "region")


def Estimate(config: SessionConfig, args: list[str]) -> dict:
    """NBINS TRACK OUT.json [SEQUENCE …]: an adaptive density of the values, as a document of edges and log densities."""
    _, (nbins, path, out, *names) = _split(args)
    spark = _session(config)
    values = hopping(read_track(config, path, names), 1).select(F.get("win", F.lit(0)).alias("value"))
    hist = estimate.gridded(estimate.value_histogram(values)).toArrow().to_pandas()
    x, n = estimate.adaptive_bins(hist["x"].tolist(), hist["n"].tolist(), int(nbins))
    rows = estimate.density(spark.createDataFrame(list(zip(x, map(float, n))), "x double, n double")).orderBy("x").collect()
    doc = {"Name": "scalar:nonparametric distribution", "Parameters": {"X": [r.x for r in rows], "Y": [r.log_density for r in rows]}, "Distributions": None}
    Path(out).write_text(json.dumps(doc, indent=2))
    return doc
