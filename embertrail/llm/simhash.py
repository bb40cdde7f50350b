"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits, found with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import GROUP_ROWS, Forest, by_key, connected_components, crossed, groups, in_blocks, saved, text_batches
from .shingles import LOWER, shingle_links

#: Generator polynomial of the perfect binary Golay code [23, 12, 7].
GOLAY = 0b101011100011
#: Segments of a fingerprint as (shift, bits): two whole Golay words and a shortened one.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Differing bits up to which the three segments' keys find every pair.
MAX_BITS = 3


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the XXH64 (seed 42) of a text's word shingles; a bit is set if over half of the hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), 0
    block: list[int] = []
    for s in shingles:
        block.append(digest(s, 42))
        if len(block) == 16384:
            total += _bits(block)
            count += len(block)
            block = []
    if block:
        total += _bits(block)
        count += len(block)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(64, np.int64)
    for i in range(0, len(raw), 255):  # sums of 255 bits fit a byte
        out += np.add.reduce(np.unpackbits(raw[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return out


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64))


@lru_cache(1)
def golay_index() -> np.ndarray:
    """For each 23-bit word, the index of the one codeword within three bits of it."""
    words = np.arange(4096, dtype=np.uint32)
    rest = words << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    code = words << 11 | rest
    bits = [1 << i for i in range(23)]
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    out = np.empty(1 << 23, np.int16)
    out[code[:, None] ^ np.array(errors, np.uint32)] = words[:, None]
    return out


def nearby(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Golay indices of each segment and of its one-bit neighbours: row numbers and indices, without repeats.

    A segment within two bits of a codeword has that one index, others have six at most. If two segments differ in one
    bit or none, the index of either is among the other's nearby ones.
    """
    t = golay_index()
    near = t[segment[:, None] ^ np.array([0, *(1 << i for i in range(bits))], np.uint32)]
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(fresh)
    return row, near[row, col].astype(np.int64)


def keys(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, row number, probe) of fingerprints, so that any two at MAX_BITS or fewer differing bits share an index and a probe key.

    Three errors over three segments leave one segment untouched and another with one error at most, or one error in
    each. So: an exact segment with a decoded one, for each order of a pair with the last segment, and both of the
    first two decoded. The decoded first pair also serves errors that spare these two.
    """
    u, all_rows = fp.view(np.uint64), np.arange(len(fp))
    part = [(u >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.uint32) for s, n in SEGMENTS]
    own = [golay_index()[p].astype(np.int64) for p in part]
    near = [nearby(p, n) for p, (_, n) in zip(part, SEGMENTS)]
    for kind, (exact, decoded) in enumerate(((0, 2), (2, 0), (1, 2), (2, 1))):
        base = part[exact].astype(np.int64) << 15 | kind
        yield base | own[decoded] << 3, all_rows, False
        row, idx = near[decoded]
        yield base[row] | idx << 3, row, True
    yield own[0] << 15 | own[1] << 3 | 4, all_rows, False
    (row_a, idx_a), (row_b, idx_b) = near[0], near[1]
    n_b = np.bincount(row_b, minlength=len(fp))
    first_b = np.cumsum(n_b) - n_b
    times = n_b[row_a]
    row = np.repeat(row_a, times)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    yield np.repeat(idx_a, times) << 15 | idx_b[first_b[row] + offset] << 3 | 4, row, True


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp_all = batch.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fp_all), 4096):
            fp = fp_all[i : i + 4096]
            for key, row, probe in keys(fp):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(np.full(len(key), probe))], ["key", "fp", "probe"])


def _links(batches: Iterator[pa.RecordBatch], limit: int = 4 * GROUP_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows (u, v) of a spanning forest of the links found; of a group of over `limit` rows the rows themselves, with their key."""
    forest = Forest()

    def out(u, v, key, probe):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), key, probe], ["u", "v", "key", "probe"])

    def flush():
        u, v = forest.edges()
        return out(u, v, pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.bool_()))

    for rows, big in groups(batches, "key", limit):
        rows = rows.combine_chunks()
        key, fp, probe = (rows.column(c).to_numpy() for c in ("key", "fp", "probe"))
        if big:
            yield out(fp, fp, pa.array(key), pa.array(probe))
            continue
        for a, b in crossed(key, probe):
            x, y = fp[a], fp[b]
            hit = (np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS) & (x != y)
            forest.link(x[hit], y[hit])
        if len(forest.up) > 500_000:
            yield flush()
    yield flush()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, also: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, the smallest id reachable over links.

    Texts link when their fingerprints differ in three bits or fewer. Only distinct fingerprints are compared, so a
    group of copies is one row; a key that very many distinct fingerprints share is dealt out in blocks, and each task
    emits a spanning forest of the links it has verified. A null or empty text has fingerprint zero and links like any
    other. Rows without an id keep their fingerprint and have the component of their group, null if no row of it has
    an id. Repeated rows stay. An empty table gives no rows; other columns are not read, but for those of `also`, which
    stay with their rows, beside _part, a fingerprint that stands for the group.
    """
    if width != 3:
        raise ValueError("fingerprints are defined on three-word shingles")
    fps = saved(text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"), *also))
    names = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = saved(by_key(names.select("fp").mapInArrow(_key_rows, "key long, fp long, probe boolean"), "key", _links, "u long, v long, key long, probe boolean"))
    hot = found.filter("key IS NOT NULL").select("key", F.col("u").alias("fp"), "probe")
    edges = found.filter("key IS NULL").select("u", "v")
    if hot.limit(1).count():
        more = by_key(in_blocks(hot), "key", lambda b: _links(b, 1 << 60), "u long, v long, key long, probe boolean")
        edges = edges.unionByName(more.select("u", "v"))
    parts = connected_components(edges).withColumnRenamed("node", "fp")
    named = names.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component_id", F.col("component").alias("_part"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(["_part", *also] if also else []))


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) per document: groups over SimHash links as in `simhash_groups`, and over similarity of 0.8 or more of
    the sets of five-word shingles as in `shingle_links`. component_id is the smallest id reachable."""
    coded = saved(simhash_groups(docs.withColumn("_h", F.xxhash64("text")), also=["_h"]).select("doc_id", "component_id", "_part", F.col("_h").alias("h")))
    named, links = shingle_links(docs)
    sets = saved(coded.select("h", "_part").distinct().join(named.distinct(), "h").select("id", F.col("_part").alias("part")).distinct())
    first = saved(sets.groupBy("id").agg(F.min("part").alias("first")))
    equal = sets.join(first, "id").select(F.col("part").alias("u"), F.col("first").alias("v"))
    ends = [first.select(F.col("id").alias(c), F.col("first").alias(f"_{c}")) for c in ("u", "v")]
    near = links.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    parts = connected_components(equal.unionByName(near)).withColumnRenamed("node", "_part")
    names = coded.groupBy("_part").agg(F.min("component_id").alias("component_id")).join(parts, "_part", "left").withColumn("component", F.coalesce("component", "_part"))
    lowest = names.groupBy("component").agg(F.min("component_id").alias("component_id"))
    return coded.select("doc_id", "_part").join(names.select("_part", "component").join(lowest, "component"), "_part").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Keep one document of each group, the one with the smallest doc_id (one row, if that id repeats); rows without an id stay."""
    keep = saved(near_copy_groups(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n")))
    once = docs.join(keep.filter("_n = 1").select("doc_id"), "doc_id", "left_semi")
    often = docs.join(keep.filter("_n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(often).unionByName(docs.filter("doc_id IS NULL"))
