from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from embertrail.llm import packing as P
from embertrail.llm.common import table

ODD = [None, "", " ", "a", "  two  spaces \n\n and \t tabs\x1c \x85 　 end ", "don't we'll I'm 12,345.67 été 中文 \U0001f600\U0001f600", "a \0b\0 \0", "x <|endoftext|> y", " lead", "z" * 3000, "\n" * 40 + " x", "word " * 9000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.VOCABULARY)


@pytest.fixture(scope="module")
def ids():
    return P.Ids(P.VOCABULARY)


def test_ids_are_the_librarys(ids, library, spark, small, monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 2000)  # forgetting changes nothing
    for text in [*ODD[1:], *(r["text"] for r in table(spark, small, "documents").select("text").collect())]:
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sltrdm\x1c\x85\xa0")), max_size=60))
def test_ids_of_any_text(ids, library, text):
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def best_fit(lengths, size):
    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(free, x)
        if i < len(free):
            left = free.pop(i) - x
        else:
            n, left = n + 1, size - x
        if left:
            insort(free, left)
    return n


def filled(plan, counts):
    """Tokens by sequence, worked out piece by piece."""
    at = {}
    for length, count in counts.items():
        rows = [p for p in plan.places if p[0] == length]
        for number in range(count):
            _, first, sequence, per, offset = max(p for p in rows if p[1] <= number)
            q = number - first
            at.setdefault(sequence + q // per, []).append((offset + q % per * length, length))
    return at


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("groups", [1, 7, 2048])
def test_plan_is_gapless_and_near_best_fit(seed, groups):
    r = random.Random(seed)
    high = r.choice([20, 60, 100])
    counts = {n: r.choice([1, 2, 9, 40]) for n in r.sample(range(1, high + 1), r.randint(1, high))}
    plan = P.Plan(counts, 100, groups, 12)
    at = filled(plan, counts)
    assert sorted(at) == list(range(plan.sequences))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 100
    if groups == 2048:
        assert plan.sequences <= 1.02 * best_fit([n for n, c in counts.items() for _ in range(c)], 100) + 1


def test_plan_does_not_grow_with_the_counts():
    r = random.Random(1)
    counts = {n: r.randint(1, 50) for n in range(1, 2049)}
    plan = P.Plan({n: c * 10**7 for n, c in counts.items()}, groups=2048)
    assert len(plan.places) < 40_000
    assert plan.sequences <= 1.005 * 10**7 * best_fit([n for n, c in counts.items() for _ in range(c)], 2048)


def run(df, library, size=P.SEQUENCE):
    out = P.packed(df, size).collect()
    docs = {}
    for r in out:
        docs.setdefault(r["doc_id"], []).append(r)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return docs, seqs


def test_pieces_and_sequences(spark, library, small):
    docs, seqs = run(table(spark, small, "documents"), library)
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    assert docs.keys() == texts.keys()
    lengths = []
    for doc_id, pieces in docs.items():
        want = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            assert r["length"] == 2048 or k == 0
            at += r["length"]
            lengths.append(r["length"])
        assert at == len(want)
    assert len(seqs) <= best_fit(lengths, 2048) + 1


def test_odd_rows(spark, library):
    rows = [(i, text, i, "x") for i, text in enumerate(ODD)] + [(1, "again", 0, "x"), (None, "no id", 0, "x"), (None, None, 0, "x")] + [(100 + i, "same text", 0, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long, part string").repartition(5)
    docs, _ = run(df, library, 64)
    assert sum(len(p) for p in docs.values()) == sum(-(-(len(library.encode(t or "", add_special_tokens=False).ids) + 1) // 64) for _, t, _, _ in rows)
    assert P.packed(df.filter("false")).count() == 0
