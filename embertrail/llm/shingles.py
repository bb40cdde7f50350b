"""Near copies by shingles: sets of five-word shingles with a Jaccard similarity of 0.8 or more, met in MinHash bands and verified whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_ROWS, Forest, by_key, groups, in_blocks, saved, small, spans, text_batches

#: Lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words of a shingle; a shorter text is one shingle.
WIDTH = 5
#: Similarity from which texts are near copies, as a fraction: shared shingles over those of either text.
LEAST = (4, 5)
#: MinHash bands and minima in each. At a similarity of 0.8 a pair shares no band in (1 - 0.8**4)**32, 5 of 10^8 cases.
BANDS, ROWS = 32, 4

_draw = np.random.default_rng(42)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, in order; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))), np.uint64, len(words) - width + 1))


def bands(members: np.ndarray) -> list[int]:
    """A key for each band of the minima of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 1024):
        np.minimum(low, (members[i : i + 1024, None] * _TIMES + _PLUS).min(axis=0), out=low)
    raw = low.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, keys) of texts (h, text): id is a hash of the set of shingles. Texts without words are left out."""
    for batch in batches:
        kept, ids, keys = [], [], []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text")):
            members = shingles(text.as_py())
            if len(members):
                kept.append(h)
                ids.append(xxhash.xxh64_intdigest(members.tobytes(), 42))
                keys += bands(members)
        offsets = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(_signed(ids)), pa.ListArray.from_arrays(offsets, pa.array(_signed(keys)))], ["h", "id", "keys"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], ["id", "members"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) of keys that several sets share."""
    for rows, big in groups(batches, "key", 4 * GROUP_ROWS):
        key, ids = (rows.column(c).to_numpy() for c in ("key", "id"))
        start, end = spans(key)
        keep = np.full(len(key), big)
        keep |= np.repeat(end - start > 1, end - start)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], ["key", "id"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of LEAST or more."""
    n, of = LEAST
    both = len(a) + len(b)
    if min(len(a), len(b)) * of < max(len(a), len(b)) * n:
        return False
    x = np.concatenate([a, b])
    x.sort(kind="stable")
    shared = int(np.count_nonzero(x[1:] == x[:-1]))
    return shared * of >= (both - shared) * n


def _links(limit: int = 4 * GROUP_ROWS):
    """Verified links (u, v), a spanning forest of them; of an oversized group its rows. `probe` is null where all rows of a key meet each other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out(u, v, key, members):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), key, members], ["u", "v", "key", "members"])

        def flush():
            u, v = forest.edges()
            return out(u, v, pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary()))

        for rows, big in groups(batches, "key", limit):
            if big:
                for b in rows.to_batches():
                    yield out(b.column("id"), b.column("id"), b.column("key"), b.column("members"))
                continue
            rows = rows.combine_chunks()
            key, ids, probe, held = rows.column("key").to_numpy(), rows.column("id").to_numpy(), rows.column("probe"), rows.column("members")
            one_role = np.array(probe.is_null())
            probe = np.array(probe.fill_null(True))
            for s, e in zip(*(x.tolist() for x in spans(key))):
                if e - s < 2:
                    continue
                root = np.array([forest.root(x) for x in ids[s:e].tolist()], np.int64)
                sets = [np.frombuffer(held[i].as_buffer(), np.uint64) for i in range(s, e)]
                for i in range(e - s):
                    if not one_role[s] and probe[s + i]:
                        continue
                    other = np.flatnonzero(probe[s:e] & (root != root[i]))
                    for j in (other[other > i] if one_role[s] else other).tolist():
                        if root[j] != root[i] and alike(sets[i], sets[j]):
                            forest.link(ids[s + i : s + i + 1], ids[s + j : s + j + 1])
                            root[(root == root[i]) | (root == root[j])] = forest.root(int(ids[s + i]))
            if len(forest.up) > 500_000:
                yield flush()
        yield flush()

    return task


def shingle_links(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(h, id) of the texts with words, and links (u, v) of ids: h is xxhash64 of a text, id a hash of its set of shingles.

    Equal sets have one id. The links join all sets that chains of pairs with a similarity of LEAST or more reach; each
    link is verified on the whole sets. Sets that share a band meet, a key that very many share in pairs of blocks.
    """
    texts = docs.select(F.col(text_col).alias("text")).select(F.xxhash64("text").alias("h"), "text")
    sketches = saved(text_batches(texts).mapInArrow(_sketches, "h long, id long, keys array<long>"))
    sets = sketches.groupBy("id").agg(F.min("h").alias("h"), F.first("keys").alias("keys"))
    met = saved(by_key(sets.select(F.explode("keys").alias("key"), "id"), "key", _meeting, "key long, id long"))
    wanted = small(saved(met.select("id").distinct().join(sketches.groupBy("id").agg(F.min("h").alias("h")), "id")))
    whole = texts.join(wanted, "h").groupBy("id", "text").agg(F.count("*").alias("_n")).select("id", "text")
    members = saved(whole.mapInArrow(_members, "id long, members binary"))
    schema = "u long, v long, key long, members binary"
    found = saved(by_key(met.join(members, "id").select("key", "id", F.lit(None).cast("boolean").alias("probe"), "members"), "key", _links(), schema))
    edges = found.filter("key IS NULL").select("u", "v")
    hot = found.filter("key IS NOT NULL").select("key", F.col("u").alias("id"), F.explode(F.array(F.lit(False), F.lit(True))).alias("probe"))
    if hot.limit(1).count():
        blocks = in_blocks(hot).join(members, "id").select("key", "id", "probe", "members")
        edges = edges.unionByName(by_key(blocks, "key", _links(1 << 60), schema).select("u", "v"))
    return sketches.select("h", "id"), edges
