from __future__ import annotations

from embertrail.operators import alignment as L


def test_a_long_chain_of_better_partners_is_paired_to_the_end(spark):
    chain = [("a", "b", i // 2 + i % 2, i // 2, 0.5 + i / 100) for i in range(13)]
    got = L.mutual_best(spark.createDataFrame(chain, "base_app string, cand_app string, l long, r long, score double"), L.PAIR, "l", "r").collect()
    assert sorted((r.l, r.r) for r in got) == [(i, i) for i in range(7)]
