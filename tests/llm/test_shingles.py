from __future__ import annotations

import random

from embertrail.llm import shingles as H
from embertrail.llm import simhash as S
from tests.llm.test_simhash import plain


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(texts):
    """Smallest id reachable over 3 bits or a Jaccard similarity of 0.8, comparing all pairs."""
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets, fps = {i: shingle_set(t) for i, t in texts.items()}, {i: plain(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            both = sets[i] | sets[j]
            if i < j and ((fps[i] ^ fps[j]).bit_count() <= 3 or (both and 5 * len(sets[i] & sets[j]) >= 4 * len(both))):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in texts}


def corpus(seed, n, copies):
    """Texts, and copies with a few words replaced: most of a similarity between 0.6 and 1."""
    r = random.Random(seed)
    texts = ["", "one", "One two", " ".join("abcde"), " ".join("abcdef")]
    for _ in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([12, 60, 150, 400]))]
        texts.append(" ".join(words))
        for _ in range(copies):
            w = list(words)
            for _ in range(r.randint(1, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = f"x{r.randrange(900)}"
            texts.append(" ".join(w))
    return texts


def groups(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return df, {r.doc_id: r.component_id for r in S.near_copy_groups(df).collect()}


def test_near_copies_beyond_three_bits_go(spark):
    texts = dict(enumerate(corpus(1, 40, 4)))
    want = brute(texts)
    df, got = groups(spark, texts)
    assert got == want
    assert len(set(want.values())) < len(set(S.simhash_groups(df).toPandas().component_id))
    assert sorted(r.doc_id for r in S.drop_near_copies(df).collect()) == sorted(set(want.values()))
    assert S.drop_near_copies(df.limit(0)).count() == 0


def test_oversized_bands_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr("embertrail.llm.common.GROUP_ROWS", 4)
    real = H._links
    monkeypatch.setattr(H, "_links", lambda limit=8: real(limit))
    texts = dict(enumerate(corpus(2, 2, 30)))
    assert groups(spark, texts)[1] == brute(texts)


def test_similarity_is_exact_at_the_limit():
    a = H.shingles(" ".join(f"w{i}" for i in range(13)))
    assert len(a) == 9
    assert H.alike(a, a[:8]) and H.alike(a[:8], a[:10]) and not H.alike(a, a[:7])
    assert H.alike(a[:5], a[:4]) and not H.alike(a[:4], a[:3])
