from __future__ import annotations

import random

import pytest

from embertrail.llm import lines as L
from embertrail.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        i, what = r.randrange(len(s) + 1), r.randrange(3)
        if what == 0:
            s.insert(i, r.choice("abxé😀 "))
        elif s and i < len(s):
            s[i : i + 1] = [] if what == 1 else [r.choice("abyß")]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance(edits):
    r = random.Random(edits)
    a = ["".join(r.choice("ab é") for _ in range(r.choice([0, 1, 2, 5, 24, 70, 130]))) for _ in range(600)]
    b = [mutated(r, s, r.randint(0, edits + 2)) for s in a]
    assert L.within(a, b, edits).tolist() == [distance(x, y) <= edits for x, y in zip(a, b)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_any_near_pair_shares_a_key(edits):
    r = random.Random(7)
    for _ in range(400):
        a = "".join(r.choice("abc ") for _ in range(r.randint(12, 60)))
        b = mutated(r, a, r.randint(0, edits))
        a, b = sorted((a, b), key=len)
        if len(a) < 12 or distance(a, b) > edits:
            continue
        index = {(len(a), i, a[s : s + n]) for i, (s, n) in enumerate(L.segments(len(a), edits))}
        assert index & {(m, i, b[s : s + n]) for m, i, s, n in L.places(len(b), edits, 12)}


def near(a, b, edits):
    """Distance at most `edits`, row by row over the cells that can be that near."""
    row = {j: j for j in range(min(len(b), edits) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            ways = [row[j - 1] + (x != b[j - 1])] if j - 1 in row else []
            ways += [row[j] + 1] if j in row else []
            ways += [new[j - 1] + 1] if j - 1 in new else []
            new[j] = i if j == 0 else min(ways)
        row = new
    return row[len(b)] <= edits


def brute(docs, edits=L.MAX_EDITS, least=L.MIN_CHARS):
    """(doc_id, text) -> (dropped line numbers, near ones), comparing all lines."""
    occ = sorted({(d is None, d or 0, h, i, s) for d, t, h in docs if t for i, s in enumerate(x.strip(" \t\r") for x in t.split("\n")) if s})
    kinds = sorted({o[4] for o in occ})
    up = {s: s for s in kinds}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and root(a) != root(b) and near(a, b, edits):
                up[root(a)] = root(b)
    first, out = {}, {}
    for o in occ:
        c = root(o[4])
        if c in first and first[c] != o:
            drop = out.setdefault((o[0], o[1], o[2]), ([], []))
            drop[0].append(o[3])
            drop[1].append(o[4] != first[c][4])
        first.setdefault(c, o)
    return out


def run(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, key long, id string")
    hashed = [(r.doc_id, r.text, r.h) for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]
    want = brute(hashed)
    expect = []
    for d, t, h in hashed:
        drop, near = want.get((d is None, d or 0, h), ([], []))
        expect.append((d, 0 if t is None else len(t.split("\n")), len(drop), sum(near), ",".join(map(str, drop))))
    assert sorted(map(tuple, L.line_report(df).collect()), key=str) == sorted(expect, key=str)
    return df


def corpus(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("etaoin shr") for _ in range(r.choice([5, 24, 25, 40, 90, 150]))) for _ in range(n)]
    docs = []
    for i in range(n):
        lines = [mutated(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randint(0, 5))] + r.sample(["", "  ", "Menu", "\tMenu ", "A common line that stands in many documents"], 3)
        docs.append((i, "\n".join(lines)))
    return docs


def test_against_all_pairs(spark):
    docs = corpus(3, 60) + [(900, None), (901, ""), (902, "\n\n"), (None, "Menu\nnew line"), (903, "x" * 30_000 + "\n" + "x" * 29_999 + "y")]
    docs += [docs[5], docs[5], (3, "another text of id three\nMenu")]
    df = run(spark, docs)
    kept = L.without_repeats(df)
    assert kept.columns == df.columns
    report = {(r.doc_id, r.n_lines): r for r in L.line_report(df).collect()}
    for r in kept.collect():
        assert r.doc_id is None or r.text is None or any(len(r.text.split("\n")) == x.n_lines - x.n_dropped for (d, _), x in report.items() if d == r.doc_id)
    assert L.line_report(df.limit(0)).count() == 0 and L.without_repeats(df.limit(0)).count() == 0


def test_oversized_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr("embertrail.llm.common.GROUP_ROWS", 4)
    real = L._links
    monkeypatch.setattr(L, "_links", lambda e, limit=8: real(e, limit))
    base = "a line with a number in it, number "
    run(spark, [(i, f"{base}{i:02d} and a tail") for i in range(40)] + [(100, f"{base}xx and a longer tail")])


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op4_line_dedup"](spark, small).collect()
    hashed = [(r.doc_id, r.text, r.h) for r in spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(text) h").collect()]
    want = brute(hashed)
    assert {r.doc_id: r.dropped for r in got} == {d: ",".join(map(str, want.get((False, d, h), ([],))[0])) for d, _, h in hashed}
    assert len(got) == len(docs)
