"""Helpers that several corpus operators share: materialising, connected components, grouped Arrow streams."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task holds at once; a larger group is dealt out as pairs of blocks of this size.
GROUP_ROWS = 4096
#: Documents that go to a Python worker at once; Spark's own default of 10,000 rows is too much for long texts.
BATCH_DOCS = 500


def saved(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage.

    The folder is the session's spark.checkpoint.dir. Where that is unset, one is made on a local master and nowhere else.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def forget(*frames: DataFrame) -> None:
    """Delete the files of saved frames that nothing reads any more; frames that came out of them and are saved themselves stay readable."""
    for df in frames:
        sc, file = df.sparkSession.sparkContext, df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Mark a saved frame for broadcast if its rows, measured, fit `most_bytes`; a larger one joins by shuffle.

    Numbers and the like count as 16 bytes, texts by their length; only other columns are written out to be measured.
    """
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.length(name), F.lit(0))
        elif kind == "array<float>" or kind == "array<double>":
            width = width + 8 * F.greatest(F.size(name), F.lit(0))
        elif "<" in kind:
            width = width + F.coalesce(F.length(F.to_json(F.struct(name))), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """Let the session of `df` send whole texts to Python workers in smaller batches; returns `df`.

    Batches are cut when a job runs, so the setting stays for the session. A smaller one that is set already is kept; no
    result depends on it.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    conf.set(key, str(min(BATCH_DOCS, int(conf.get(key, "10000")))))
    return df


#: Neighbours from which a node is hot: its minimum is sent to all tasks. Of n edges, at most n / HOT_NODE nodes are.
HOT_NODE = 100_000


def _with_least(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """(u, v, m): m is the smallest neighbour of u. The minima are saved and added to `used`. Minima that are few, counted, are broadcast, and of many those of hot nodes,
    so that no task meets all neighbours of a node; the others join by shuffle."""
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    used.append(least)
    if least.count() * 24 <= 8 << 20:
        return edges.join(F.broadcast(least.select("u", "m")), "u").select("u", "v", "m")
    hot = F.broadcast(least.filter(F.col("n") >= HOT_NODE).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(least.filter(F.col("n") < HOT_NODE).select("u", "m"), "u")
    return edges.join(hot, "u").select("u", "v", "m").unionByName(cold.select("u", "v", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u long, v long): component is the smallest node reachable.

    Alternates large-star and small-star steps, which halve path lengths, until the edge set stays as it is. Nulls and
    self-loops are ignored; no edges give no rows. Of the rounds only the last one's files stay.
    """
    cur = saved(
        edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.bit_xor(F.xxhash64("v", "u"))).first())

    now = state(cur)
    while now[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        used = [cur]
        large = _with_least(both, used).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        pairs = _with_least(large, used).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = saved(pairs.select("e.u", "e.v").filter("u <> v").distinct())
        forget(*used)
        before, now = now, state(cur)
        if before == now:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Union-find over int64 ids that one task has linked; `edges` is a spanning forest, so output stays linear."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = self.root(x), self.root(y)
            if rx != ry:
                self.up[max(rx, ry)] = min(rx, ry)
                self.up.setdefault(min(rx, ry), min(rx, ry))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = [x for x in self.up if self.root(x) != x]
        out = np.array(nodes, np.int64), np.array([self.root(x) for x in nodes], np.int64)
        self.up = {}
        return out


def groups(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Cut a stream sorted by `key` into tables of whole groups; a group of over `limit` rows comes as slices, flagged True.

    Holds at most about `limit` rows and one batch.
    """
    held: list[pa.RecordBatch] = []
    n, big = 0, None  # big: the key of an oversized group that is being passed through
    for batch in batches:
        while batch.num_rows:
            k = batch.column(key).to_numpy(zero_copy_only=False)
            if big is not None:
                stop = int(np.searchsorted(k, big, side="right"))
                if stop:
                    yield pa.Table.from_batches([batch.slice(0, stop)]), True
                    batch = batch.slice(stop)
                if batch.num_rows:
                    big = None
                continue
            last = int(np.searchsorted(k, k[-1], side="left"))
            tail_key = held[-1].column(key)[-1].as_py() if held else None
            if last or (held and tail_key != k[-1]):
                yield pa.Table.from_batches([*held, batch.slice(0, last)]), False
                held, n, batch = [], 0, batch.slice(last)
            held.append(batch)
            n += batch.num_rows
            if n > limit:
                big = int(k[-1])
                yield pa.Table.from_batches(held), True
                held, n = [], 0
            break
    if held:
        yield pa.Table.from_batches(held), False


def spans(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.r_[start[1:], len(key)] if len(key) else start


def crossed(key: np.ndarray, probe: np.ndarray, at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (index row, probe row) of all pairs within each run of `key`, some at a time."""
    start, end = spans(key)
    for wide in (False, True):
        a_all, b_all, total = [], [], 0
        for s, e in zip(start.tolist(), end.tolist()):
            if e - s < 2 or (e - s > 64) != wide:
                continue
            rows = np.arange(s, e)
            a, b = rows[~probe[s:e]], rows[probe[s:e]]
            step = max(1, at_once // max(1, len(b)))
            for i in range(0, len(a), step):
                part = a[i : i + step]
                a_all.append(np.repeat(part, len(b)))
                b_all.append(np.tile(b, len(part)))
                total += len(a_all[-1])
                if total >= at_once:
                    yield np.concatenate(a_all), np.concatenate(b_all)
                    a_all, b_all, total = [], [], 0
        if total:
            yield np.concatenate(a_all), np.concatenate(b_all)


def in_blocks(hot: DataFrame, key: str = "key") -> DataFrame:
    """Deal the rows of oversized groups (key, probe boolean, ...) out to pairs of blocks.

    A group of m rows gets b = ceil(m / GROUP_ROWS) blocks by a hash of the row; an index row goes to the b tasks of
    its block row, a probe row to the b tasks of its block column. So every (index row, probe row) pair meets once.
    """
    size = hot.groupBy(key).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_b"))
    h = F.pmod(F.xxhash64(*[c for c in hot.columns if c not in (key, "probe")]), F.col("_b"))
    x = hot.join(size, key).withColumn("_own", h).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    i, j = F.when(F.col("probe"), F.col("_other")).otherwise(F.col("_own")), F.when(F.col("probe"), F.col("_own")).otherwise(F.col("_other"))
    return x.withColumn(key, F.xxhash64(key, i, j)).drop("_b", "_own", "_other")


def by_key(df: DataFrame, key: str, task: Callable, schema: str, spread: bool = False) -> DataFrame:
    """Shuffle by `key`, sort each partition by it and run `task` over its Arrow batches. `spread` keeps as many partitions as
    the session has for shuffles, where few bytes are much work."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()  # workers live on, with what they hold

    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key)) if spread else df.repartition(F.col(key))
    return dealt.sortWithinPartitions(key).mapInArrow(tidy, schema)
