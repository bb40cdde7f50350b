from __future__ import annotations

from embertrail.plans import detectors as D
from embertrail.plans import nodes as N

NODES = [
    ("0", "Exchange", "Exchange hashpartitioning(k#1, 200), ENSURE_REQUIREMENTS"), ("0.0", "SortMergeJoin", "SortMergeJoin [cast(k#1 as bigint)], [j#2L], Inner"), ("0.0.0", "Sort", "Sort [k#1 ASC]"),
    ("0.0.0.0", "Exchange", "Exchange hashpartitioning(cast(k#1 as bigint), 200), ENSURE_REQUIREMENTS"), ("0.0.0.0.0", "Project", "Project [k#1, v#3]"), ("0.0.1", "Scan", "Scan x[j#2L]"),
]


def frames(spark, metrics=()):
    n = spark.createDataFrame([("a", 1, *r) for r in NODES], "app_id string, execution_id long, path string, name string, detail string")
    return n, spark.createDataFrame([("a", 1, *m) for m in metrics], "app_id string, execution_id long, path string, metric string, value double")


def test_exchanges_split_and_cut_segments(spark):
    n, _ = frames(spark)
    split = N.split_exchanges(n)
    got = {r.path: (r.name, r.half) for r in split.collect()}
    assert got["0"] == ("Exchange", "read") and got["0.0"] == ("Exchange", "write") and got["0.0.0"][0] == "SortMergeJoin" and got["0.0.0.0.0"] == ("Exchange", "read") and got["0.0.0.0.0.0"] == ("Exchange", "write") and got["0.0.0.0.0.0.0"][0] == "Project"
    parts = {r.path: (r.segment, r.depth, r.parent) for r in N.segments(split).collect()}
    assert parts["0"] == ("0", 0, None) and parts["0.0.0"] == ("0.0", 1, "0") and parts["0.0.0.0.0"] == ("0.0", 1, "0") and parts["0.0.0.0.0.0.0"] == ("0.0.0.0.0.0", 2, "0.0")
    stages = spark.createDataFrame([("a", 1, 7, 100, 50), ("a", 1, 8, 200, 90)], "app_id string, execution_id long, stage_id long, submitted_ms long, stage_ms long")
    link = N.segment_stages(N.segments(split), stages)
    assert {(r.segment, r.stage_id, r.inherited) for r in link.collect()} == {("0.0.0.0.0.0", 7, False), ("0.0", 8, False), ("0", 8, True)}
    times = spark.createDataFrame([("a", 1, "0.0.0", 3.0), ("a", 1, "0.0.0.0", 1.0)], "app_id string, execution_id long, path string, own_ms double")
    ms = {r.path: r.ms for r in N.node_durations(N.segments(split), times, link, stages).collect()}
    assert ms["0.0.0"] == 67.5 and ms["0.0.0.0"] == 22.5 and ms["0.0.0.0.0.0.0"] == 25.0
    assert "0" not in ms and sum(ms.values()) == 140.0  # what only inherits a stage gets no time of it
    whole = {r.path: r.ms for r in N.node_durations(N.segments(split), times, link, stages, inclusive=True).collect()}
    assert whole["0.0"] == 90.0 and whole["0.0.0.0"] == 22.5 and whole["0.0.0.0.0.0"] == 50.0


def test_segments_beyond_the_stages_inherit_from_the_nearest(spark):
    # A root over two joins; the left one has two shuffles below it, the right one has one, of which one has a shuffle below.
    rows = [("0", 0, None), ("0.0", 1, "0"), ("0.1", 1, "0"), ("0.0.0", 2, "0.0"), ("0.0.1", 2, "0.0"), ("0.1.0", 2, "0.1"), ("0.1.0.0", 3, "0.1.0")]
    parts = spark.createDataFrame([("a", 1, p, p, d, up) for p, d, up in rows], "app_id string, execution_id long, path string, segment string, depth long, parent string")
    stages = spark.createDataFrame([("a", 1, i, 100 * i) for i in (1, 2, 3, 4)], "app_id string, execution_id long, stage_id long, submitted_ms long")
    got = {r.segment: (r.stage_id, r.inherited) for r in N.segment_stages(parts, stages).collect()}
    assert got == {"0.1.0.0": (1, False), "0.0.0": (2, False), "0.0.1": (3, False), "0.1.0": (4, False), "0.0": (2, True), "0.1": (4, True), "0": (2, True)}
    assert {r.stage_id for r in N.segment_stages(parts, stages.filter("false")).collect()} == {None}


def test_spill_width_and_casts(spark):
    n, m = frames(spark, [("0.0.0", "spill size", 10.0), ("0.0.0.0", "data size", 100.0), ("0.0.0.0", "shuffle records written", 4.0)])
    s = N.spill_operators(n, m).first()
    assert (s.path, s.bytes, s.feeds) == ("0.0.0", 10.0, "0.0")
    w = {r.path: (r.columns, r.bytes_per_row) for r in N.exchange_width(n, m).collect()}
    assert w["0.0.0.0"] == (2, 25.0)
    assert [(r.path, r.value) for r in D.join_key_casts(n).collect()] == [("0.0", 1.0)]


def test_merges(spark):
    for name in ("number of target rows rewritten unmodified", "number of rows copied"):
        for copied, updated, want in ((500_000.0, 10.0, 1), (99_999.0, 10.0, 0), (100_000.0, 50_000.0, 1), (100_000.0, 50_001.0, 0)):
            n, m = frames(spark, [("0", name, copied), ("0", "number of updated rows", updated)])
            assert [(r.path, r.metric, r.band) for r in D.merge_rewrites(n, m).collect()] == [("0", "rows copied", "info")] * want
    for before, after, partitions, touched, want in ((10.0, 9.0, 10.0, 5.0, 1), (10.0, 8.9, 10.0, 5.0, 0), (7.0, 7.0, 10.0, 5.0, 0), (10.0, 9.0, 10.0, 5.1, 0), (10.0, 9.0, 1.0, 0.0, 0)):
        rows = [("number of rows copied", 5.0), ("number of target files before skipping", before), ("number of target files after skipping", after), ("number of target partitions after skipping", partitions), ("number of target partitions from which files were removed", 1.0), ("number of target partitions to which files were added", touched)]
        n, m = frames(spark, [("0", *r) for r in rows])
        assert [r.metric for r in D.merge_rewrites(n, m).collect()] == ["files kept"] * want
