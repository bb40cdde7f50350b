from __future__ import annotations

import hashlib
import zlib

import pytest

from embertrail.llm import merkle as M
from embertrail.llm.queries import ORACLE_SQL, QUERIES


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root, and for each node its siblings by level as (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            low = p - p % 16
            steps[i].append(("".join(nodes[low:p]), "".join(nodes[p + 1 : low + 16])))
            at[i] = p // 16
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def expect(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        trees.setdefault(source, []).append((doc_id, leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, changed if hit else text))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[s] = climb([x[1] for x in trees[s]])
    root, tops = climb([built[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (doc_id, own, changed), steps in zip(trees[s], built[s][1]):
            for left, right in [*steps, *top]:
                changed = H(left, changed, right)
            out.append((doc_id, own, built[s][0], root, H(*(x for step in [*steps, *top] for x in step)), changed, changed == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree long, node string, pos int").repartition(4)
    return sorted(map(tuple, M.manifest(df).collect()), key=str)


def rows_of(n, source, start=0):
    return [(start + i, f"Text {i} of {source}" * (i % 3), "en", source, i) for i in range(n)]


@pytest.mark.parametrize("span", [1, 2, 3])
def test_trees_of_many_sizes(spark, monkeypatch, span):
    monkeypatch.setattr(M, "SPAN", span)
    rows, at = [], 0
    for n, s in [(1, "a"), (2, None), (16, "b"), (17, "é"), (256, "z￿"), (257, "z\U00010000"), (600, "A"), (1, "")]:
        rows += rows_of(n, s, at)
        at += n
    assert run(spark, rows) == expect(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "", "", 0), (5, "", "", "", 0), (5, "Other", None, "", 0), (-7, "ABC" * 90_000, "en", "s", 3), (2**62, "İÉ \U0001f600", "en", "s", -1)]
    assert run(spark, rows) == expect(rows)
    assert run(spark, rows[5:6]) == expect(rows[5:6])
    assert run(spark, rows_of(40, "one")) == expect(rows_of(40, "one"))
    many = [(i, "T", "en", f"s{i}", 1) for i in range(300)]
    assert run(spark, many) == expect(many)
    assert M.manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).count() == 0


def test_query_and_sql(spark, small):
    import duckdb

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, small).collect()), key=str)
    assert got == expect(list(map(tuple, docs)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op12_merkle_manifest"]).fetchall(), key=str) == got


def test_plan_is_native(spark, small):
    plan = QUERIES["op12_merkle_manifest"](spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop"))
