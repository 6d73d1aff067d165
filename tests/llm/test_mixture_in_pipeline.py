"""The mixture's order reaches the packed sequences."""

import corpus_pipeline
from trackengine.llm import common, mixing, packing

from ..conftest import SMALL


def test_run_changes_with_the_weights(spark, monkeypatch):
    docs = common.table(spark, SMALL, "documents")
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    out = []
    for first in (sources[0], sources[-1]):
        weights = {s: 1000 if s == first else 1 for s in sources}
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixture", lambda s, d, _, w=weights: mixing.mixed(d, w, block_docs=1)), ("best-fit packing", corpus_pipeline.packing_stage)])
        place = {r.doc_id: r.position for r in mixing.mix(docs, weights, block_docs=1).collect()}
        rows = corpus_pipeline.run(spark, SMALL).collect()
        lowest = {}
        for r in rows:
            lowest[r.sequence_id] = min(place[r.doc_id], lowest.get(r.sequence_id, 10**9))
        assert sorted(lowest) == list(range(len(lowest))) and [lowest[i] for i in sorted(lowest)] == sorted(lowest.values())
        out.append({tuple(r) for r in rows})
    assert out[0] != out[1]
    assert {r[:5] for r in out[0]} == {r[:5] for r in out[1]}


def test_order_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 3)
    docs = common.table(spark, SMALL, "documents")
    whole = packing.pack(docs, capacity=256).toPandas()
    got = packing.pack(docs.selectExpr("*", "199 - doc_id % 200 AS p"), 256, order=common.F.col("p")).toPandas()
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[same].values.tolist())) == sorted(map(tuple, whole[same].values.tolist()))
    first = (199 - got.doc_id % 200).groupby(got.sequence_id).min()
    assert first.index.tolist() == list(range(whole.sequence_id.nunique())) and first.is_monotonic_increasing
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 256
