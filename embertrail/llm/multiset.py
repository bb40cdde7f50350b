"""Document fingerprints: a homomorphic multiset hash, wide vectors hashed from a text's paragraphs summed modulo 2**32."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: The vector: LEVELS x BLOCKS cells of LANES 32-bit lanes. Level i receives 2**-(i + 1) of the parts, so some level is sparse.
LEVELS, BLOCKS, LANES = 12, 32, 4
#: Words of a part at most, and rows that one range of doc_id holds about, with the most ranges.
PART_WORDS, RANGE_ROWS, RANGES = 16, 500, 10_000

_SENTENCE = re.compile(r"(?<=[.!?] )")


def parts(text: str) -> Iterator[bytes]:
    """The hashed parts: each paragraph's sentences, long ones cut every PART_WORDS words, each behind a digest of the part before it in its paragraph."""
    for paragraph in text.split("\n") if text else ():
        before = b""
        for sentence in _SENTENCE.split(paragraph):
            words = sentence.split(" ")
            for i in range(0, len(words), PART_WORDS):
                piece = (sentence if len(words) <= PART_WORDS else " ".join(words[i : i + PART_WORDS])).encode("utf-8", "surrogatepass")
                yield before + piece
                before = xxhash.xxh3_64_digest(piece)


def vector(text: str | None) -> np.ndarray:
    """The fingerprint as lanes [LEVELS * BLOCKS, LANES]. vector(a + "\\n" + b) is vector(a) + vector(b) for texts that aren't empty."""
    out = np.zeros((LEVELS * BLOCKS, LANES), np.uint32)
    cells, lanes = [], []
    for part in parts(text or ""):
        h = xxhash.xxh3_64_intdigest(part, 1)
        level = min((h & -h).bit_length() - 1, LEVELS - 1) if h else LEVELS - 1  # trailing zeros
        cells.append(level * BLOCKS + (h >> 40) % BLOCKS)
        lanes.append(xxhash.xxh3_128_digest(part))
    if cells:
        np.add.at(out, cells, np.frombuffer(b"".join(lanes), "<u4").reshape(-1, LANES))
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Insert the paragraphs of `b`."""
    return a + b


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Delete the paragraphs of `b`."""
    return a - b


def digest(v: np.ndarray) -> str:
    """The vector as text: a bitmap of its cells that aren't zero, then these cells, in hex."""
    full = v.any(axis=1)
    return np.packbits(full).tobytes().hex() + v[full].astype("<u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of occupied cells in which two fingerprints agree, from the finest level up that is not crowded in either; two empty ones: 1.

    Estimates how many of the parts in either text are in both.
    """
    full_a, full_b = (x.any(axis=1).reshape(LEVELS, BLOCKS) for x in (a, b))
    either = full_a | full_b
    if not either.any():
        return 1.0
    crowd = np.maximum(full_a.sum(axis=1), full_b.sum(axis=1)) > 0.7 * BLOCKS
    first = min(int(np.flatnonzero(crowd)[-1]) + 1 if crowd.any() else 0, LEVELS - 1)
    same = (a == b).all(axis=1).reshape(LEVELS, BLOCKS) & either
    used = either[first:].sum()
    return float(same[first:].sum() / used) if used else float((a == b).all())


def edited(text: str, following: str) -> str:
    """`text` with its last third (rounded down) replaced by as many first characters of `following`, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, behind them the first row of the next range (head), of which only the first counts."""
    held = None  # (doc_id, text, vector) of the row before

    for batch in batches:
        rows = []
        ids, texts, heads = (batch.column(c).to_pylist() for c in ("doc_id", "text", "head"))
        for doc_id, text, head in zip(ids, texts, heads):
            text = text or ""
            if head and held is None:
                continue
            v = vector(text)
            if held is not None:
                changed = edited(held[1], text)
                w = vector(changed)
                sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((held[0], len(held[1]), sha, digest(held[2]), digest(w), likeness(held[2], w), likeness(held[2], v)))
            held = None if head else (doc_id, text, v)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _OUT)] if rows else [pa.nulls(0, f.type) for f in _OUT], schema=_OUT)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: n_chars, its fingerprint, and those of an edited text and how near they are.

    The next document is the one with the next smaller doc_id, after the last the first; rows without an id come last,
    rows that repeat an id follow by text. A null text is empty. An empty text has the zero fingerprint. A table of one
    row is its own next document; an empty table gives no rows. Other columns are not read.

    Documents are dealt out by ranges of doc_id (about RANGE_ROWS rows each) and sorted there; each range also gets the
    first row of the range after it, so texts move once and no task sees more than its ranges.
    """
    docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        placed = docs.withColumn("range", F.lit(0))
    else:
        split = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep")
        placed = split.transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
        placed = placed.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_range").cast("int"))).drop("_id", "_range")
    # One row a range: at most RANGES + 1 rows come to the driver.
    firsts = placed.select("doc_id", "range").groupBy("range").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("range")).collect()
    before = [(firsts[i - 1]["range"], r["doc_id"]) for i, r in enumerate(firsts)]
    heads = F.broadcast(docs.sparkSession.createDataFrame(before, "range int, head_id long"))
    heads = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head_id"))).select("doc_id", "text", "range", F.lit(True).alias("head"))
    rows = placed.select("doc_id", "text", "range", F.lit(False).alias("head")).unionByName(heads)
    rows = rows.repartition("range").sortWithinPartitions("range", "head", F.col("doc_id").desc_nulls_last(), "text")
    return rows.select("doc_id", "text", "head").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
