from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from embertrail.llm import simhash as S
from embertrail.llm.common import connected_components, groups
from embertrail.llm.queries import QUERIES


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s.encode(), 42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """Smallest id reachable, by comparing all pairs."""
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def test_golay_table_covers_every_word():
    t = S.golay_index()
    assert np.bincount(t, minlength=4096).tolist() == [2048] * 4096


def test_keys_meet_for_all_pairs_within_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.int64)
    b = a.copy().view(np.uint64)
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    index, probe = set(), set()
    for key, row, is_probe in S.keys(a):
        if not is_probe:
            index.update(zip(key.tolist(), row.tolist()))
    for key, row, is_probe in S.keys(b.view(np.int64)):
        if is_probe:
            probe.update(zip(key.tolist(), row.tolist()))
    assert {r for _, r in index & probe} == set(range(3000))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "Ä a b c\x0bd e f", "x y z " * 9000])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain(text)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(900)}" for _ in range(60)) for _ in range(30)]
    texts = [None, "", *base]
    for t in base[:20]:
        for _ in range(6):
            w = t.split()
            w[rng.integers(len(w))] = f"x{rng.integers(9)}"
            texts.append(" ".join(w))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, texts[4], "no id")]
    got = S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = components({i: plain(t) for i, t in enumerate(texts)})
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
            assert r.fingerprint == f"{plain(texts[r.doc_id]):016x}"
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_oversized_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_ROWS", 4)
    monkeypatch.setattr("embertrail.llm.common.GROUP_ROWS", 4)
    centre = 0x1234_5678_9ABC_DEF0
    fps = [centre] + [centre ^ (1 << i) for i in range(64)] + [centre ^ (7 << i) for i in range(0, 60, 3)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), bool(p)) for f in fps for p in (0, 1)], "fp long, probe boolean").selectExpr("7L AS key", "fp", "probe")
    found = S.by_key(df, "key", lambda b: S._links(b, 8), "u long, v long, key long, probe boolean").collect()
    hot = spark.createDataFrame([(r.key, r.u, r.probe) for r in found if r.key is not None], "key long, fp long, probe boolean")
    assert hot.count() == len(df.collect())
    edges = S.by_key(S.in_blocks(hot), "key", lambda b: S._links(b, 1 << 60), "u long, v long, key long, probe boolean")
    comp = connected_components(edges.select("u", "v")).collect()
    assert len(comp) == len(set(fps)) and len({r.component for r in comp}) == 1


def test_groups_cut_at_keys():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.record_batch([pa.array(keys[i : i + 2])], ["key"]) for i in range(0, len(keys), 2)]
    got = [(t.column("key").to_pylist(), big) for t, big in groups(iter(batches), "key", 4)]
    assert sum((k for k, _ in got), []) == keys
    assert all(set(k) == {3} for k, big in got if big) and not any(3 in k for k, big in got if not big)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 150)}


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (5, "p q r s t"), (5, "p q r s t"), (9, "zz yy xx ww vv uu"), (None, "a b c d")]
    got = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 5, 9]


def test_query_covers_all_documents(spark, small):
    got = QUERIES["op1_simhash_near_dedup"](spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: r.component_id for r in got} == components({i: plain(t) for i, t in docs.items()})


def test_components_with_hot_nodes_and_long_paths(spark, monkeypatch):
    from embertrail.llm import common as C

    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(399, 1060), (5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    want = {i: 0 for i in [*range(400), *range(1000, 1061)]} | {7000: 7000, 7001: 7000}
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in C.connected_components(df).collect()} == want
    monkeypatch.setattr(C, "HOT_NODE", 20)
    real = C.DataFrame.count
    monkeypatch.setattr(C.DataFrame, "count", lambda self: 1 << 40 if self.columns == ["u", "m", "n"] else real(self))  # too many to broadcast
    assert {r.node: r.component for r in C.connected_components(df).collect()} == want
