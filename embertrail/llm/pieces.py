"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import text_batches

#: Where the public vocabulary lies by default; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words, and pairs of pieces, that a worker remembers at most.
KNOWN_WORDS, KNOWN_PAIRS = 1_000_000, 500_000

_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; groups don't occur in model files."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buf):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, buf[at : at + size]
            at += size


class Pieces:
    """The pieces of a SentencePiece model, and encoding and decoding with them.

    `encode` finds the best path over the text's pieces, left to right. For a unigram model a path's score is the sum of
    its pieces' scores. For a BPE model a path may only join two pieces if merging their characters alone, by score,
    gives back those two; then each prefix has one path, the one that merging the whole prefix gives, as merges never
    cross the boundaries of the result. So the search holds back-pointers for a window of the longest piece, and what
    the paths from all its positions share is committed.

    Only models without a normalisation map are taken; characters without a piece become byte pieces, or unknown.
    """

    def __init__(self, model: bytes) -> None:
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.text: list[bytes] = []
        self.byte: dict[int, int] = {}
        self.unknown, self.bpe, self.prefix, self.silent = 0, False, True, set()
        for field, value in _fields(model):
            if field == 1:
                self._add({k: v for k, v in _fields(value)})
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models with identity normalisation that keep all white space are supported")
        self.worst = min(self.score, default=0.0) - 10  # of a character without a piece
        self.longest = max(map(len, self.ids), default=1)
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # neighbours that some piece holds
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.ids)  # then no piece crosses the start of a word
        self.commits = 0  # times that a window's paths have converged
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.known_words = KNOWN_WORDS

    def _add(self, piece: dict) -> None:
        i, text, kind = len(self.score), piece[1].decode(), piece.get(3, 1)
        self.score.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
        self.text.append(text.replace(SPACE, " ").encode())
        if kind == 6:
            self.byte[int(text[3:5], 16)] = i
            self.text[i] = bytes([int(text[3:5], 16)])
        elif kind == 2:
            self.unknown = i
            self.text[i] = " ⁇ ".encode()
        elif kind == 3:
            self.silent.add(i)
            self.text[i] = b""
        else:
            self.ids[text] = i

    def _merged(self, s: str) -> list[str]:
        """Neighbours merged while any two make a piece, the best score first, then the leftmost. For strings of two pieces' length."""
        parts = list(s)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, where = self.score[k], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _joins(self, a: str, b: str, key: int) -> bool:
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        joins = self.pairs[key] = self._merged(a + b) == ([a, b] if a else [b])
        return joins

    def paths(self, s: str) -> Iterator[str]:
        """Pieces of the best path, yielded as soon as all paths that may still win share them."""
        longest, ids, tails, pairs, bpe = self.longest, self.ids, self.tails, self.pairs, self.bpe
        base, back, best = 0, [0], [0.0]  # back[i], best[i]: of position base + i
        last, number = [""], [-1]  # last[i]: the piece that ends there, and its id; -1: none, so nothing before it can merge
        get, size = ids.get, len(self.score)
        check = 2 * longest
        for end in range(1, len(s) + 1):
            ways = []
            for start in range(end - 1, max(base, end - longest) - 1, -1):
                piece = s[start:end]
                if (i := get(piece)) is not None:
                    ways.append((start, piece, i))
                elif piece not in tails:
                    break
            if not ways or ways[0][0] != end - 1:
                ways.insert(0, (end - 1, s[end - 1], -1))
            if bpe:
                for start, piece, i in reversed(ways):
                    before = number[start - base]
                    joins = pairs.get(key := before * size + i)
                    if joins or i < 0 or joins is None and self._joins(last[start - base] if before >= 0 else "", piece, key):
                        break
            else:
                value, start, piece, i = max((best[a - base] + (self.score[i] if i >= 0 else self.worst), a, p, i) for a, p, i in ways)
                best.append(value)
            back.append(start)
            last.append(piece)
            number.append(i)
            if end - base >= check:
                live = set(range(end - longest + 1, end + 1))
                while len(live) > 1 and (top := max(live)) > base:
                    live.remove(top)
                    live.add(back[top - base])
                shared = live.pop()
                if shared > base:
                    self.commits += 1
                    yield from self._walk(back, last, base, shared)
                    cut = shared - base
                    back, last, number, best, base = back[cut:], last[cut:], number[cut:], best[cut:], shared
                check = end - base + longest
        yield from self._walk(back, last, base, len(s))

    @staticmethod
    def _walk(back: list[int], last: list[str], base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = back[end - base]
        return out[::-1]

    def _coded(self, part: str) -> bytes:
        out: list[int] = []
        for piece in self.paths(part):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += (self.byte[b] for b in piece.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def _stretches(self, part: str) -> bytes:
        """Ids of a part, searched between neighbours that no piece holds together: all paths converge there, and what a stretch gives is remembered."""
        inside, stems, out, start = self.inside, self.stems, [], 0
        for end in range(1, len(part) + 1):
            if end == len(part) or part[end - 1 : end + 1] not in inside:
                stretch = part[start:end]
                if (code := stems.get(stretch)) is None:
                    code = self._coded(stretch)
                    if end - start <= 64:
                        if len(stems) >= self.known_words:
                            stems.clear()
                        stems[stretch] = code
                out.append(code)
                start = end
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one.

        Where no piece crosses the start of a word, all paths converge there, so the window commits at each such boundary,
        and within a word at each pair of characters that no piece holds; what the search gave for the stretch between two
        of them is remembered. Other models take `paths` from end to end.
        """
        if not text:
            return np.zeros(0, np.uint32)
        s = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.by_word:
            return np.frombuffer(self._coded(s), "<u4")
        out, words = [], self.words
        for part in _PARTS.findall(s):
            code = words.get(part)
            if code is None:
                code = self._stretches(part)
                if len(part) <= 64:
                    if len(words) >= self.known_words:
                        words.clear()
                    words[part] = code
            out.append(code)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space put before it; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        if self.prefix and raw[:1] == b" " and (len(ids) and int(ids[0]) != self.unknown):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """One for each worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encoded(docs: DataFrame, model_path: str = MODEL, keep: tuple[str, ...] = ("doc_id",), remember: int = KNOWN_WORDS) -> DataFrame:
    """One row per row of `docs`: the columns `keep`, ids array<int>. The model file, read on the driver, goes out with the job.

    A worker remembers the ids of `remember` words at most, which takes some 250 bytes each.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = loaded(model.value)
        pieces.known_words = remember
        for s in texts:
            yield pd.Series([pieces.encode(t).astype(np.int32) for t in s])

    return text_batches(docs).select(*keep, encode(F.col("text")).alias("ids"))


def decoded(rows: DataFrame, model_path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the text of each row's ids; null or no ids give an empty text."""
    with open(model_path, "rb") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(StringType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = loaded(model.value)
        for s in ids:
            yield pd.Series([pieces.decode(np.asarray([] if i is None else i, np.int64)) for i in s])

    return rows.select(*keep, decode(F.col("ids")).alias("text"))


def piece_report(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit numbers), n_bytes of the decoded text, round_trip.

    round_trip tells whether decoding gives the text back; texts that hold the piece for a space itself do not come
    back, as in any such encoding. Whole texts are encoded; a null or empty text has no ids and comes back as empty.
    Repeated rows are encoded each; an empty table gives no rows.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_ids long, ids_sha256 string, n_bytes long, round_trip boolean")
    def report(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model.value)
        pieces.known_words = KNOWN_WORDS
        for s in texts:
            ids = [pieces.encode(t) for t in s]
            back = [pieces.decode(i) for i in ids]
            yield pd.DataFrame({
                "n_ids": [len(i) for i in ids], "ids_sha256": [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
                "n_bytes": [len(b.encode()) for b in back], "round_trip": [b == (t or "") for b, t in zip(back, s)],
            })

    return text_batches(docs).select("doc_id", report(F.col("text")).alias("r")).select("doc_id", "r.*")
