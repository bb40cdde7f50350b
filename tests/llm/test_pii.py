from __future__ import annotations

import hashlib
import re

import pytest

from embertrail.llm import pii as P
from embertrail.llm.queries import QUERIES

PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERN.items()) for m in re.finditer(p, text or "") if fits(k, m.group())]
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def held(rows, docs):
    texts = dict(docs)
    for r in rows:
        want = base(texts[r.doc_id])
        assert hashlib.sha256(listed(want).encode()).hexdigest() == r.base_sha256, (r, want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in want) for x in PATTERN)
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))
        assert len(list(filter(None, r.spans.split(",")))) == len(want) + r.n_added


TEXTS = [
    None, "", "no data", "a@b", "a@b.c", "x@@y.z", "a.b@c.d_e@f.g", "a@b.c.d@e.f", "..@a..b.c", "mail é😀 me.55@mail9.example.com!", "a@b-.c-", "a@.b.c",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "0001.255.256.1", "000255.0.00.000", "1.2.3", "12.34.56.789 10.0.0.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111", "x4111 1111 1111  1111", "79927398713", "1 2 3 4 5 6 7 8 9 0 1 2", "0000 0000 0000", "-4111111111111111-", "4111\t1111",
    "41111111111111", "411111111111111", "4111\ue0001111 1111 1111", "a@b\ue000c.de", "a@b.c\ue000d",
    "+1 (017) 555-7713 and +1 (974) 555-3436", "+12", "+1 2", "+123456789", "+1234567890123456", "++49 30 1234567)", "+1 (017) 555-7713 (", "0810992847249404 +1 (171) 555-2028",
    "8" * 5000, "8 " * 3000, "a." * 3000 + "@b.c", "a@" + "b." * 3000, "1." * 3000, "+" * 3000 + "1 234 567 89",
]


def test_base_spans(spark):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, spans string, row int")
    got = P.personal_data(df).collect()
    assert len(got) == len(docs)
    held(got, docs)


def test_contexts_find_unseen_identifiers(spark):
    docs = [(i, f"Please write.\nContact address: me{i}@host{i}.org or ring.\nCall us on +1 (555) 010-{1000 + i} today") for i in range(12)]
    docs += [(50, "Contact address: root@localhost or ring."), (51, "Call us on 555-010-7777 today"), (52, "pages 120-130 555-010-7777"), (53, "he said root@localhost"), (54, "Contact address: none"), (55, "Contact address: a@b.org")]
    got = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    held(got.values(), docs)
    assert got[50].spans == "email:17:31" and got[51].spans == "phone:11:23"
    assert all(got[i].n_added == 0 for i in (52, 53, 54, 55, *range(12)))


def test_scores(spark):
    rows = [(0, "a b", f"s{i}", True) for i in range(4)] + [(0, "a b", "u", False), (0, "c d", "u", False), (0, "c d", "v", False)]
    got = {r.context: (round(r.trust, 3), r.seeds) for r in P.scored_contexts(spark.createDataFrame(rows, "rank int, context string, txt string, seed boolean"), 1).collect()}
    assert got == {"a b": (0.8, 4), "c d": (0.0, 0)}
    more = {r.context: r.trust for r in P.scored_contexts(spark.createDataFrame(rows, "rank int, context string, txt string, seed boolean"), 3).collect()}
    assert more["a b"] > 0.8 and 0 < more["c d"] < 0.75


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert P.personal_data(spark.createDataFrame([], schema)).count() == 0
    got = P.personal_data(spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")], schema)).collect()
    assert [r.n_email for r in got] == [1, 1, 1]


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op10_pii"](spark, small)
    assert all(x not in got._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    held(got.collect(), docs)


def brute_added(docs):
    """doc_id -> spans that trusted contexts add, by dictionaries over all texts."""
    maybe = [(i, re.compile(p)) for i, (_, p) in enumerate((n, p.replace("++", "+")) for n, p in P._MAYBE.values())]

    def contexts(t, s, e):
        left, right = t[max(0, s - P.CONTEXT_CHARS) : s], t[e : e + P.CONTEXT_CHARS]
        found = [re.search(p, x) for p, x in ((r"(?:^|\s)(\S+[^\S\n]+\S+)[^\S\n]+$", left), (r"^[^\S\n]+(\S+[^\S\n]+\S+)(?:\s|$)", right), (r"(?:^|\s)(\S+)[^\S\n]+$", left), (r"^[^\S\n]+(\S+)(?:\s|$)", right))]
        b, h, last, first = (m and m.group(1) for m in found)
        out = [b and "<" + b, h and ">" + h, last and first and f"={last} {first}"]
        return [re.sub(r"[0-9]+|\s+", "0", c.lower()) for c in out if c]

    graph, spans = {}, {}
    for d, t in docs:
        known = base(t)
        rows = [(s, i, e, True) for s, i, e, _ in known]
        rows += [(m.start(), i, m.end(), False) for i, p in maybe for m in p.finditer(t or "") if not any(s < m.end() and m.start() < e for s, _, e, _ in known)]
        for s, i, e, seed in rows:
            for c in contexts(t, s, e):
                edge = graph.setdefault((i, c), {})
                edge[t[s:e].lower()] = edge.get(t[s:e].lower(), False) or seed
                if not seed:
                    spans.setdefault((i, c), set()).add((d, s, i, e))
    score = {}
    for (i, _), members in graph.items():
        for x, seed in members.items():
            score[i, x] = max(score.get((i, x), 0.0), float(seed))
    for turn in range(P.ROUNDS):
        trust = {k: (sum(score[k[0], x] for x in m) / len(m), sum(m.values())) for k, m in graph.items()}
        if turn + 1 < P.ROUNDS:
            distrust, seeds = {}, set()
            for (i, c), m in graph.items():
                t, n = trust[i, c]
                for x, seed in m.items():
                    distrust[i, x] = distrust.get((i, x), 1.0) * (1 - min(t * n / (n + 1), 0.999))
                    seeds |= {(i, x)} if seed else set()
            score = {k: 1.0 if k in seeds else 1 - v for k, v in distrust.items()}
    good = {k for k, (t, n) in trust.items() if t >= P.TRUST and n >= P.SEEDS}
    out = {}
    for k in good & spans.keys():
        for d, *span in spans[k]:
            out.setdefault(d, set()).add(tuple(span))
    return out


def test_added_spans_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += [(10_000 + i, f"ring 555-010-{1000 + i} any time\nmail to bob{i}@localhost for it\nring +1 (555) 010-{1000 + i} any time\nmail to ann{i}@host.org for it") for i in range(9)]
    docs += [(20_000 + i, f"my number is +49 30 123456{i} I said. The host 10.0.0.{i} is up. Or 030/1234/99 is yours") for i in range(5)]
    docs += [(30_000, "030/1234/567 is mine. A number is 040-123-456 I said"), (30_001, "number 040-123-456 I"), (30_002, "")]
    got = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    held(got.values(), docs)
    want = brute_added(docs)
    assert len(want) > 9
    for d, t in docs:
        spans = sorted({(s, i, e, k) for s, i, e, k in base(t)} | {(s, i, e, P.KINDS[i]) for s, i, e in want.get(d, ())})
        assert got[d].spans == listed(spans) and got[d].n_added == len(want.get(d, ()))


def test_a_text_of_very_many_matches(spark):
    text = "a@b.cd " * 4_000
    got = P.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    held([got], [(1, text)])
