"""Line dedup: equal lines by hash, near-equal ones by a segment-partition edit join, verified with banded bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GROUP_ROWS, Forest, by_key, connected_components, crossed, groups, in_blocks, saved, small, spans, text_batches

#: Edits up to which lines are near-equal, and characters that both lines then have at least; shorter lines only match as a whole.
MAX_EDITS, MIN_CHARS = 2, 24
#: Columns of the edit distance after which pairs are looked at for giving up.
LOOK = 8

#: White space that is taken off both ends before lines are compared.
_EDGE = " \t\r"


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 even segments of a line; the last ones are the longer."""
    short, extra = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = short + (i >= edits + 1 - extra)
        out.append((at, n))
        at += n
    return out


def places(length: int, edits: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(shorter length, segment, start, characters) of the substrings of a line of `length` that may equal a segment of a line
    that is shorter by up to `edits` or as long: the shift at segment i is at most i before it and edits - i behind it."""
    for gap in range(edits + 1):
        if length - gap < least:
            break
        for i, (at, n) in enumerate(segments(length - gap, edits)):
            first = max(0, at - i, at + gap - (edits - i))
            last = min(length - n, at + i, at + gap + (edits - i))
            for start in range(first, last + 1):
                yield length - gap, i, start, n


def _line_id(line: Column) -> Column:
    return F.xxhash64(line).bitwiseAND(F.lit(-4))


#: Roles of a key in the two low bits of a line's id: an index key, a probe key, or both.
INDEX, PROBE, BOTH = 0, 1, 2


def roles(length: int, edits: int, least: int) -> list[tuple[int, int, int, int]]:
    """(first byte, byte behind, seed, role) of the keys of a line in UTF-32: a segment at its own place is index and probe key in one."""
    own = {(length, s, a, k) for s, (a, k) in enumerate(segments(length, edits))}
    looked = set(places(length, edits, least))
    return [(4 * a, 4 * (a + k), m * 64 + s, BOTH if (m, s, a, k) in own & looked else PROBE if (m, s, a, k) in looked else INDEX) for m, s, a, k in sorted(own | looked)]


def _key_rows(edits: int, least: int, remember: int = 200_000):
    """(key, line): line is the line's id with the key's role. Repeats of a line within a task are mostly left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, where, seen = xxhash.xxh3_64_intdigest, {}, set()
        keys, ids, kinds = [], [], []

        def out() -> pa.RecordBatch:
            line = np.repeat(np.array(ids, np.uint64), [len(k) for k in kinds]) | (np.concatenate(kinds) if kinds else np.zeros(0, np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (np.array(keys, np.uint64), line)], ["key", "line"])

        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    line = line.strip(_EDGE)
                    n = len(line)
                    if n < least:
                        continue
                    i = xxhash.xxh64_intdigest(line.encode(), 42) & ~3
                    if i in seen:
                        continue
                    if len(seen) >= remember:
                        seen.clear()
                    seen.add(i)
                    if n not in where:
                        places_of = roles(n, edits, least)
                        where[n] = [p[:3] for p in places_of], np.array([p[3] for p in places_of], np.uint64)
                    spec, kind = where[n]
                    wide = line.encode("utf-32-le")
                    keys += [digest(wide[a:b], s) for a, b, s in spec]
                    ids.append(i)
                    kinds.append(kind)
                if len(keys) > 100_000:
                    yield out()
                    keys, ids, kinds = [], [], []
        yield out()

    return task


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, probe), each once, of keys that an index row and a probe row of different lines share."""
    for rows, big in groups(batches, "key", 4 * GROUP_ROWS):
        key, line = (rows.column(c).to_numpy() for c in ("key", "line"))
        if not big:
            start, end = spans(key)
            many = np.repeat(end - start > 1, end - start)  # most keys stand alone
            key, line = key[many], line[many]
        key, line = np.unique(np.stack([key, line], axis=1), axis=0).T
        keep = np.ones(len(key), bool)
        if not big and len(key):
            start, end = spans(key)
            ids = line & -4
            lines = np.add.reduceat(np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])].astype(np.int64), start)
            index, probe = (np.add.reduceat((line & 3 != no).astype(np.int64), start) for no in (PROBE, INDEX))
            keep = np.repeat((lines > 1) & (index > 0) & (probe > 0), end - start)
        key, line = key[keep], line[keep]
        index, probe = line & 3 != PROBE, line & 3 != INDEX
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[key[index], key[probe]]), pa.array(np.r_[line[index], line[probe]] & -4), pa.array(np.arange(index.sum() + probe.sum()) >= index.sum())], ["key", "id", "probe"])


def within(a: list[str], b: list[str], edits: int, cells: int = 4_000_000) -> np.ndarray:
    """Whether a[i] and b[i] are at most `edits` apart (insertions, deletions, substitutions): pairs in order of length, so
    that what is padded to the longest of a batch stays within `cells` characters, or is one pair."""
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    out, order, at = np.zeros(len(a), bool), np.argsort(size, kind="stable"), 0
    while at < len(a):
        end = at + 1
        while end < len(a) and (end + 1 - at) * int(size[order[end]]) <= cells:
            end += 1
        rows = order[at:end]
        out[rows] = _banded([a[i] for i in rows], [b[i] for i in rows], edits)
        at = end
    return out


def _banded(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """The distance test for pairs at once.

    A band of 2 * edits + 1 diagonals is held as bits: of vertical steps up (vp) and down (vn), in a frame that moves
    down a row with each column. The distance is followed along the band's last diagonal to the last row, then along it.
    Every few columns, pairs that are beyond `edits` in the whole band are given up.
    """
    n, m = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    out = np.zeros(len(a), bool)
    rows = np.flatnonzero((np.abs(n - m) <= edits) & (n >= edits))
    short = np.flatnonzero((np.abs(n - m) <= edits) & (n < edits))
    out[short] = True  # so short that replacing all of the longer one is near enough
    out[short[np.maximum(n[short], m[short]) > edits]] = False
    for i in short[np.maximum(n[short], m[short]) > edits].tolist():  # the shorter one has room for the band
        out[i] = n[i] < m[i] and bool(_banded([b[i]], [a[i]], edits)[0])
    if not len(rows):
        return out
    n, m, width = n[rows], m[rows], 2 * edits + 1
    p = np.zeros((len(rows), int(n.max()) + 2 * edits + int(m.max()) + 2), np.uint32)
    t = np.zeros((len(rows), int(m.max())), np.uint32)
    for k, r in enumerate(rows.tolist()):
        p[k, edits : edits + n[k]] = np.frombuffer(a[r].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        t[k, : m[k]] = np.frombuffer(b[r].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    mask, power = (1 << width) - 1, 1 << np.arange(width)
    vp, vn = np.full(len(rows), mask & ~((1 << edits) - 1), np.int64), np.zeros(len(rows), np.int64)
    far = np.full(len(rows), edits, np.int64)
    for j in range(1, t.shape[1] + 1):
        same = (p[:, j - 1 : j - 1 + width] == t[:, j - 1 : j]) @ power
        d0 = ((((same & vp) + vp) ^ vp) | same | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        slope = j + edits <= n
        bit = np.clip(n - j + edits, 0, width)
        step = np.where(slope, 1 - (d0 >> (width - 1) & 1), (hp >> bit & 1) - (hn >> bit & 1))
        far += np.where(j <= m, step, 0)
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
        if j % LOOK == 0:
            here, least = far.copy(), far.copy()  # up the column from the band's last row
            for i in range(width - 2, -1, -1):
                here += (vn >> i & 1) - (vp >> i & 1)
                np.minimum(least, here, out=least)
            go = np.flatnonzero((j < m) & ((least <= edits) | ~slope))
            if len(go) < 0.7 * len(rows):
                out[rows[(j >= m) & (far <= edits)]] = True
                rows, n, m, p, t, vp, vn, far = rows[go], n[go], m[go], p[go], t[go], vp[go], vn[go], far[go]
                if not len(rows):
                    return out
    out[rows] = far <= edits
    return out


def _links(edits: int, limit: int = 4 * GROUP_ROWS):
    """Verified links (u, v), a spanning forest of them; of an oversized group its rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out(u, v, key, probe, text):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), key, probe, text], ["u", "v", "key", "probe", "text"])

        def flush():
            u, v = forest.edges()
            return out(u, v, *(pa.nulls(len(u), t) for t in (pa.int64(), pa.bool_(), pa.string())))

        for rows, big in groups(batches, "key", limit):
            rows = rows.combine_chunks()
            key, line, probe = (rows.column(c).to_numpy() for c in ("key", "id", "probe"))
            if big:
                for b in rows.to_batches():
                    yield out(b.column("id"), b.column("id"), b.column("key"), b.column("probe"), b.column("text"))
                continue
            text = rows.column("text")
            for a, b in crossed(key, probe, 4096):
                new = np.array([x != y and forest.root(x) != forest.root(y) for x, y in zip(line[a].tolist(), line[b].tolist())], bool)
                a, b = a[new], b[new]
                if len(a):
                    hit = within(text.take(pa.array(a)).to_pylist(), text.take(pa.array(b)).to_pylist(), edits)
                    forest.link(line[a[hit]], line[b[hit]])
            if len(forest.up) > 500_000:
                yield flush()
        yield flush()

    return task


def near_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(id, class) of the lines that are near another: id from xxhash64, class the smallest id reachable over links."""
    if least <= edits:
        raise ValueError("lines must be longer than the edits allowed")
    keys = text_batches(docs).select("text").mapInArrow(_key_rows(edits, least), "key long, line long")
    met = saved(by_key(keys, "key", _meeting, "key long, id long, probe boolean"))
    wanted = small(saved(met.select("id").distinct()))
    line = F.explode(F.split("text", "\n", -1))
    texts = docs.select(line.alias("text")).select(F.btrim("text", F.lit(_EDGE)).alias("text")).filter(F.length("text") >= least).withColumn("id", _line_id(F.col("text")))
    texts = texts.join(wanted, "id").groupBy("id", "text").agg(F.count("*").alias("_n")).select("id", "text")
    rows = met.join(small(saved(texts)), "id").select("key", "id", "probe", "text")
    schema = "u long, v long, key long, probe boolean, text string"
    found = saved(by_key(rows, "key", _links(edits), schema, spread=True))
    hot = found.filter("key IS NOT NULL").select("key", F.col("u").alias("id"), "probe", "text")
    edges = found.filter("key IS NULL").select("u", "v")
    if hot.limit(1).count():
        edges = edges.unionByName(by_key(in_blocks(hot), "key", _links(edits, 1 << 60), schema).select("u", "v"))
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("class"))


def repeated_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h, dropped, n_near) of documents with lines that aren't the first of their class; h is xxhash64 of the text.

    Lines are compared without the white space at their ends. A class is a line's copies, or, for lines of `least`
    characters or more, all lines reachable over links of `edits` edits or fewer. Its first line, by doc_id (rows
    without one last), then h, then place, stays. Blank lines always stay. `dropped` are line numbers from 0.
    """
    line = F.posexplode(F.split("text", "\n", -1)).alias("place", "text")
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), line).withColumn("text", F.btrim("text", F.lit(_EDGE))).filter("text <> ''")
    lines = saved(lines.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "place").alias("at"), _line_id(F.col("text")).alias("id"), F.hash("text").alias("tag")))
    near = small(saved(near_lines(docs, edits, least)))
    lines = lines.join(near, "id", "left").select("at", F.coalesce("class", "id").alias("class"), F.when(F.col("class").isNull(), F.col("tag")).otherwise(0).alias("tag"), "id")
    first = lines.groupBy("class", "tag").agg(F.count("*").alias("n"), F.min(F.struct("at", "id")).alias("first")).filter("n > 1")
    first = small(saved(first.select("class", "tag", "first")))
    later = lines.join(first, ["class", "tag"]).filter(F.col("at") != F.col("first.at"))
    out = later.groupBy("at.doc_id", "at.h").agg(F.sort_array(F.collect_set("at.place")).alias("dropped"), F.size(F.collect_set(F.when(F.col("id") != F.col("first.id"), F.col("at.place")))).alias("n_near"))
    return out


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, n_near (dropped, and not equal to the line that stays), dropped (line numbers, comma-joined).

    Rows that repeat both id and text are one document and keep the same lines. A null text has no lines, an empty one
    a blank line. An empty table gives no rows. See `repeated_lines`.
    """
    drops = repeated_lines(docs).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "dropped", "n_near")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    rows = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return rows.select("doc_id", "n_lines", F.greatest(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated lines cut from `text`, and `n_chars`, if there, counted anew; documents left with blank lines only by that go."""
    drops = small(saved(repeated_lines(docs).select("doc_id", "h", "dropped")))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("h")).alias("l")
    rows = rows.join(drops.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda s, i: ~F.array_contains("dropped", i))
    rows = rows.select("row", "dropped", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    rows = rows.filter(F.col("dropped").isNull() | (F.btrim("text", F.lit(_EDGE + "\n")) != ""))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("dropped").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
