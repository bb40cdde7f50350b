from __future__ import annotations

import random

import pytest
import sentencepiece

from embertrail.llm import pieces as P
from embertrail.llm.queries import QUERIES

RAW = open(P.MODEL, "rb").read()
TEXTS = ["", "a", " a  b ", "Hello, world!\nTwo\tlines", "▁x", "😀 é ß 中文 русский", "a" * 500, "   " * 40, "the" * 200, "!!??##" * 50, "<s> </s> <0x41> <unk>", "\x00\x07", "1234567890" * 20]


def random_texts(n):
    r = random.Random(4)
    alphabet = "etaoinshrdlu   .,\nABCé中ß😀\t▁0123"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 300))) for _ in range(n)]


def as_unigram(raw):
    """The model file with its type changed, for the library's own unigram search over the same pieces and scores."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb2.ModelProto()
    m.ParseFromString(raw)
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -5 - (i * 7919 % 10007) / 1000
    return m.SerializeToString()


def test_same_ids_as_the_library():
    own, lib = P.Pieces(RAW), sentencepiece.SentencePieceProcessor(model_proto=RAW)
    for t in TEXTS + random_texts(300):
        ids = own.encode(t)
        assert ids.tolist() == lib.encode(t), t
        assert own.decode(ids) == lib.decode(ids.tolist())


def test_same_ids_without_cutting_at_words():
    own, lib = P.Pieces(RAW), sentencepiece.SentencePieceProcessor(model_proto=RAW)
    own.by_word = False
    for t in TEXTS + random_texts(60):
        assert own.encode(t).tolist() == lib.encode(t), t


def test_unigram_model():
    raw = as_unigram(RAW)
    own, lib = P.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in random_texts(60):
        got, want = own.encode(t), lib.encode(t)
        assert own.decode(got) == lib.decode(want)
        score = [sum(own.score[i] for i in ids if i not in own.byte.values()) for ids in (got.tolist(), want)]
        assert score[0] >= score[1] - 1e-3  # the library adds in single precision


def test_pieces_come_before_the_text_ends():
    own, s = P.Pieces(RAW), "▁the▁cat" * 1000

    class Watched(str):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Watched.read = max(Watched.read, key.stop)
            return str.__getitem__(self, key)

    at = most = 0
    for piece in own.paths(Watched(s)):
        at += len(piece)
        most = max(most, Watched.read - at)
    assert at == len(s) and most <= 4 * own.longest


def test_round_trip(spark):
    rows = [(i, t, 1) for i, t in enumerate([None, *TEXTS])] + [(1, "a", 2), (None, "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = P.encoded(df)
    back = {(r.doc_id, r.text) for r in P.decoded(coded).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t, _ in rows}
    report = P.piece_report(df).collect()
    assert len(report) == len(rows) and all(r.round_trip for r in report if r.doc_id is None or "▁" not in (rows[r.doc_id][1] or ""))
    assert P.piece_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, small):
    import hashlib

    import numpy as np

    lib = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op2_sentencepiece"](spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        want = lib.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()) and r.round_trip


def test_window_from_end_to_end_gives_what_the_query_gives(small, spark):
    fast, slow = P.Pieces(RAW), P.Pieces(RAW)
    slow.by_word = False  # no boundary is known beforehand: paths must converge
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()] + ["x" * 5000, "ab" * 3000, "é😀 " * 500]
    for t in texts:
        before = slow.commits
        assert slow.encode(t).tolist() == fast.encode(t).tolist()
        assert not t or len(t) < 200 or slow.commits > before
    assert slow.commits > 100
