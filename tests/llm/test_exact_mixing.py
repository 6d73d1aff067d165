"""Schedules by exact weights, against fractions."""

import math
from fractions import Fraction

import pytest

from trackengine.llm import mixing


def test_windows_are_those_of_the_exact_weights(spark):
    rows = [(i, "a") for i in range(1500)] + [(2000 + i, "b") for i in range(40)] + [(3000 + i, None) for i in range(9)]
    weights = {"a": 0.9, "b": 0.0973, None: 1e-4}
    total = sum(map(Fraction, weights.values()))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1, slots=10).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows))) and {r.doc_id for r in got} == {r[0] for r in rows}
    assert len({r.slot for r in got}) == len(rows) and [r.slot for r in got] == sorted(r.slot for r in got)
    for r in got:
        w = Fraction(weights[r.source]) / total
        assert (r.release, r.deadline) == (math.floor(r.block / w), math.ceil((r.block + 1) / w)) and r.release <= r.slot < r.deadline


def test_more_sources_than_slots(spark):
    rows = [(i, f"s{i % 23}") for i in range(230)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=2, slots=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(230)) and all(r.release <= r.slot < r.deadline for r in got)
    with pytest.raises(ValueError):
        mixing.whole_weights([1, 0])


def test_repeats_of_a_key_are_counted_and_all_come_back(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(5, "a")] * 100 + [(None, "a")] * 21 + [(i, "b") for i in range(40)] + [(5, "b")] * 8 + [(None, None)] * 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=4).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted(((r.doc_id, r.source) for r in got), key=str) == sorted(rows, key=str)
    for key, source in ((5, "a"), (None, "a"), (5, "b"), (None, None)):
        own = sorted(r["rank"] for r in got if (r.doc_id, r.source) == (key, source))
        assert own == list(range(own[0], own[0] + rows.count((key, source))))
    for source in ("a", "b", None):
        own = sorted(r["rank"] for r in got if r.source == source)
        assert own == list(range(len(own)))
