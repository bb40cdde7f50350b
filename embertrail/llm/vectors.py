"""Embedding near-duplicates: random projections decoded to E8 lattice points in several tables, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_ROWS, Forest, by_key, connected_components, crossed, groups, in_blocks, saved, small, spans

#: Tables, neighbouring cells probed in each, and the lattice's scale on projections of unit vectors. At a cosine of
#: 0.98 one table finds about 0.82 of the pairs in one direction, six tables over 0.9999.
TABLES, PROBES, SCALE, SEED = 6, 8, 1.0, 42

_KEYS = "key long, probe boolean, k long, sketch long"
_OUT = "u long, v long, more long, key long, probe boolean, k long"


@lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: steps from a lattice point to its neighbours."""
    two = [np.eye(8)[i] * s + np.eye(8)[j] * t for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = np.where(np.arange(256)[:, None] >> np.arange(8) & 1, -0.5, 0.5)
    return np.r_[np.array(two), signs[(signs < 0).sum(axis=1) % 2 == 0]]


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: where the rounded sum is odd, the coordinate rounded furthest goes the other way."""
    f = np.rint(y)
    gap = y - f
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(gap[odd]).argmax(axis=1)
    f[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest lattice points: E8 is the integer points of even sum and their copy shifted by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(64)
def _projection(dim: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, number]).normal(size=(dim, 8))


@lru_cache(64)
def _mixers(label: str, dim: int, number: int) -> tuple[np.ndarray, np.uint64]:
    rng = np.random.default_rng([number, dim, *label.encode()])
    return rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, dtype=np.uint64)


def cells(x: np.ndarray, label: str, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Cell keys [row, table, 1 + probes] of unit vectors: own cell first, then the neighbours nearest to the projection."""
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    step = roots()
    for t in range(tables):
        y = x @ _projection(x.shape[1], t, seed) / scale
        point = nearest_e8(y)
        closest = np.argpartition(-((y - point) @ step.T), probes, axis=1)[:, :probes]
        all_points = np.concatenate([point[:, None], point[:, None] + step[closest]], axis=1)
        mix, add = _mixers(label, x.shape[1], t)
        h = ((2 * all_points).astype(np.int64).view(np.uint64) * mix).sum(axis=2, dtype=np.uint64) + add
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, t] = (h ^ h >> np.uint64(32)).view(np.int64)
    return out


@lru_cache(64)
def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 64]).normal(size=(dim, 64))


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """On which sides of 64 random planes vectors lie, a bit each."""
    return np.packbits(x @ _planes(x.shape[1], seed) > 0, axis=1, bitorder="little").view("<i8")[:, 0]


def most_bits(least: float) -> int:
    """Bits in which the sketches of two vectors at a cosine of `least` differ at most: eight deviations over the mean, which
    less than one pair in 10**8 at 0.98 exceeds."""
    p = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    return int(np.ceil(64 * p + 8 * np.sqrt(64 * p * (1 - p))))


def _by_shape(table: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(label, row numbers, matrix of unit vectors) for the rows of each label and dimension."""
    column = table.column("e").combine_chunks()
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    label = table.column("label").combine_chunks().dictionary_encode()
    kind = label.indices.to_numpy().astype(np.int64) << 32 | np.diff(ends)
    order = np.argsort(kind, kind="stable")
    for start, end in zip(*spans(kind[order])):
        rows = order[start:end]
        x = flat[ends[rows][:, None] + np.arange(kind[rows[0]] & 0xFFFFFFFF)].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
        yield label.dictionary[int(kind[rows[0]] >> 32)].as_py(), rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _key_rows(tables: int, probes: int, scale: float, seed: int):
    """(key, probe, k, sketch) for the own cell and the probed ones of each class; the vectors stay behind."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(i, 1024)]).combine_chunks()
                k_all = part.column("k").to_numpy()
                for label, rows, x in _by_shape(part):
                    c, k, sketch = cells(x, label, tables, probes, scale, seed), k_all[rows], sketches(x, seed)
                    wide = np.concatenate([c[:, :, :1], c], axis=2).reshape(len(rows), -1)  # the index row, then the probes
                    probe = np.tile(np.arange(2 + probes) > 0, tables * len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(wide.ravel()), pa.array(probe), *(pa.array(np.repeat(v, wide.shape[1])) for v in (k, sketch))], ["key", "probe", "k", "sketch"])

    return task


def _meeting(bits: int):
    """Rows (key, probe, k) that meet a row of the other role and another class with a sketch at most `bits` away; an
    oversized group passes whole."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, big in groups(batches, "key", 4 * GROUP_ROWS):
            key, probe, k, sketch = (rows.column(c).to_numpy() for c in ("key", "probe", "k", "sketch"))
            keep = np.full(len(key), big)
            for a, b in () if big else crossed(key, probe):
                hit = (k[a] != k[b]) & (np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)) <= bits)
                keep[a[hit]] = keep[b[hit]] = True
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(probe[keep]), pa.array(k[keep])], ["key", "probe", "k"])

    return task


def _links(least: float, tables: int, probes: int, scale: float, seed: int, limit: int = 4 * GROUP_ROWS):
    """Spanning forest of the verified links (u, v), copies linked to each class (u, more), rows of oversized groups.

    `cell` is the key of the lattice cell also where `key` is that of a pair of blocks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, more = Forest(), {}
        names = ["u", "v", "more", "key", "probe", "k"]

        def out(u, v, n):
            nothing = [pa.nulls(len(u), t) for t in (pa.int64(), pa.bool_(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, n)] + nothing, names)

        for rows, big in groups(batches, "key", limit):
            if big:
                for b in rows.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64())] * 3 + [b.column(c) for c in ("key", "probe", "k")], names)
                continue
            rows = rows.combine_chunks()
            key, cell, probe, k, n = (rows.column(c).to_numpy() for c in ("key", "cell", "probe", "k", "n"))
            for label, own, x in _by_shape(rows):
                for a, b in _close(key[own], probe[own], x, least):
                    a, b = a[k[own[a]] != k[own[b]]], b[k[own[a]] != k[own[b]]]
                    if not len(a):
                        continue
                    used, place = np.unique(np.r_[a, b], return_inverse=True)
                    c = cells(x[used], label, tables, probes, scale, seed)
                    ia, ib = place[: len(a)], place[len(a) :]
                    meets = (c[ia, :, :1] == c[ib]).any(axis=2)  # the first row's own cell is among the other's probes
                    back = (c[ib, :, :1] == c[ia]).any(axis=2)
                    here = (c[ia, :, 0] == cell[own[a], None]).argmax(axis=1)
                    before = np.arange(tables) < here[:, None]
                    first = ~((meets | back) & before).any(axis=1) & ((k[own[a]] < k[own[b]]) | ~back[np.arange(len(a)), here])
                    a, b = own[a[first]], own[b[first]]
                    forest.link(k[a], k[b])
                    for u, m in zip(np.r_[k[a], k[b]].tolist(), np.r_[n[b], n[a]].tolist()):
                        more[u] = more.get(u, 0) + m
            if len(more) > 500_000:
                u, v = forest.edges()
                yield out(u, v, np.zeros(len(u), np.int64))
                yield out([*more], [*more], [*more.values()])
                more = {}
        u, v = forest.edges()
        yield out(u, v, np.zeros(len(u), np.int64))
        yield out([*more], [*more], [*more.values()])

    return task


def _close(key: np.ndarray, probe: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index row, probe row) within a key whose unit vectors have at least this cosine."""
    start, end = spans(key)
    narrow = np.zeros(len(key), bool)
    for s, e in zip(start.tolist(), end.tolist()):
        if e - s <= 64:
            narrow[s:e] = True
            continue
        a, b = s + np.flatnonzero(~probe[s:e]), s + np.flatnonzero(probe[s:e])
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 1024):
                hit = np.nonzero(x[a[i : i + 1024]] @ x[b[j : j + 1024]].T >= least)
                yield a[i + hit[0]], b[j + hit[1]]
    rows = np.flatnonzero(narrow)
    for a, b in crossed(key[rows], probe[rows], 100_000):
        a, b = rows[a], rows[b]
        hit = np.einsum("ij,ij->i", x[a], x[b]) >= least
        yield a[hit], b[hit]


def embedding_groups(df: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """One row per row of `df` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine, in double precision, is `least` or more.
    Equal vectors are one class with a count, so a group of copies is one row; a pair of classes is counted in the
    first table and direction in which it meets, and each task emits counts and a spanning forest, never all pairs of
    a group. Cell keys travel with a 64-bit sketch; only rows that meet one near theirs fetch their vector, to be
    verified. A cell that very many vectors share is dealt out in blocks. A vector that is null, empty, zero or holds a
    null or non-finite component, or has no label, links with nothing, nor do vectors of different lengths. A row
    without vec_id links like any other; its kept is null, as is the component_id of a group in which no row has an id.
    Rows that repeat a vec_id are vectors of their own. For far larger tables take a smaller `scale` and more tables.
    """
    kind = df.schema["embedding"].dataType.simpleString()
    e = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), F.col("label").cast("string").alias("label"))
    odd = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("label").isNotNull() & ~odd & (F.array_max(F.transform("e", F.abs)) > 0)
    rows = rows.withColumn("h", F.when(good, F.struct(F.xxhash64("label", "e").alias("a"), F.xxhash64(F.lit(seed), "e", "label").alias("b"))))
    classes = rows.filter("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("e").alias("e"))
    classes = saved(classes.withColumn("k", F.monotonically_increasing_id()))
    deal = (tables, probes, scale, seed)
    keyed = classes.select("k", "label", "e").mapInArrow(_key_rows(*deal), _KEYS)
    met = saved(by_key(keyed, "key", _meeting(most_bits(least)), "key long, probe boolean, k long"))
    held = classes.select("k", "label", "e", "n").join(small(saved(met.select("k").distinct())), "k")
    whole = small(saved(held))
    found = saved(by_key(met.withColumn("cell", F.col("key")).join(whole, "k"), "key", _links(least, *deal), _OUT))
    hot = found.filter("key IS NOT NULL").select("key", "probe", "k", F.col("key").alias("cell"))
    edges = found.filter("key IS NULL").select("u", "v", "more")
    if hot.limit(1).count():
        edges = saved(edges.unionByName(by_key(in_blocks(hot).join(whole, "k"), "key", _links(least, *deal, 1 << 60), _OUT).select("u", "v", "more")))
    parts = connected_components(edges.select("u", "v")).withColumnRenamed("node", "k")
    links = edges.filter("u = v").groupBy("u").agg(F.sum("more").alias("more")).withColumnRenamed("u", "k")
    named = classes.select("h", "k", "n", "first_id").join(parts, "k", "left").join(links, "k", "left").withColumn("component", F.coalesce("component", "k"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select("h", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    lonely = rows.filter("h IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.filter("h IS NOT NULL").select("vec_id", "h").join(named, "h").select("vec_id", "n_links", "component_id").unionByName(lonely)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
