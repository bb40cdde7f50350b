"""Merkle manifest of a dataset: trees of SHA-256 digests by source, of which only every few levels are stored. DataFrame functions only.

H is the lowercase hex SHA-256 of its inputs, concatenated. Nodes that lie in one aligned subtree of a stored level meet
as one row with a short array; the levels between are worked out from that array where they are needed and not kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

#: Nodes of a run, which share a parent, and levels from one stored level to the next.
FAN, SPAN = 16, 3
#: A row's leaf is tampered with where its id's CRC-32 is divisible by this.
TAMPER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """H of the five fields: `-` for a null, else the length in bytes, a colon and the value."""
    fields = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields])


def depth(n: Column) -> Column:
    """Times that n nodes are gathered in runs until one is left."""
    return sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(15)), F.lit(0))


def in_order(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Rows of `df` (saved) sorted by group and order over range partitions, `_p` and `_i` saying where each one lies. A large group spans many."""
    keys = F.col(group).asc_nulls_first(), *order
    return saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))


def offsets(rows: DataFrame, group: str) -> DataFrame:
    """For rows of `in_order`, one row a group and partition: _first (its least _i there), _before (rows of the group in earlier partitions) and n (rows of the group)."""
    each = rows.groupBy(group, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(group, "_p", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))


def placed(rows: DataFrame, table: DataFrame, group: str) -> DataFrame:
    """Rows of `in_order` with `pos` in their group, from 0, and what else `table` (from `offsets`) has."""
    there = small(saved(table.withColumnsRenamed({group: "_group", "_p": "_part"})))
    out = rows.join(there, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_p") == F.col("_part")))
    return out.withColumn("pos", F.col("_i") - F.col("_first") + F.col("_before")).drop("_group", "_part", "_first", "_before", "_p", "_i")


def _run_of(nodes: str) -> Callable[[Column], Column]:
    return lambda start: F.slice(nodes, start, F.lit(FAN))


def _gathered(nodes: DataFrame, level: int) -> DataFrame:
    """A row for each aligned subtree of a stored level: tree, g, n, its nodes in order (`items`), and SPAN + 1 arrays of digests, `l0` those nodes, each next one the parents.

    Where a tree has one node left, it stays as it is. A subtree has at most FAN ** SPAN nodes, however large its tree.
    """
    own = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    out = nodes.groupBy("tree", F.expr(f"pos div {FAN**SPAN}").alias("g")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *own))).alias("items"))
    out = out.withColumn("depth", depth(F.col("n"))).withColumn("l0", F.col("items.node"))
    for k in range(SPAN):
        starts = F.sequence(F.lit(1), F.size(f"l{k}"), F.lit(FAN))
        runs = F.transform(starts, _run_of(f"l{k}"))
        parents = F.transform(runs, lambda run: digest(F.array_join(run, "")))
        out = out.withColumn(f"l{k + 1}", F.when(F.col("depth") > level + k, parents).otherwise(F.col(f"l{k}")))
    return out


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (tree, n, pos, node, ...) of level 0 and, saved, of every SPAN-th level above, up to one node a tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    stored, level = [nodes], 0
    while FAN**level < most:
        up = _gathered(stored[-1].select("tree", "n", "pos", "node"), level)
        stored.append(saved(up.select("tree", "n", F.col("g").alias("pos"), F.element_at(f"l{SPAN}", 1).alias("node"))))
        level += SPAN
    return stored


def _below(nodes: DataFrame, level: int, above: DataFrame, make: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """Explode each subtree of a stored level into rows: `make` gives columns from a node and its path to the root.

    `above` (tree, pos, path, ...) has the paths of the nodes that stand over the subtrees. A path is an array with a struct for each
    level: `l` and `r`, the siblings to the left and to the right, joined.
    """

    def path(i: Column) -> Column:
        steps = []
        for k in range(SPAN):
            j = F.floor(i / FAN**k).cast("int")
            start = j - j % FAN
            steps.append(F.struct(F.array_join(F.slice(f"l{k}", start + 1, j - start), "").alias("l"), F.array_join(F.slice(f"l{k}", j + 2, start + FAN - j - 1), "").alias("r")))
        own = F.slice(F.array(*steps), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(SPAN), F.col("depth") - level)))
        return F.concat(own, F.col("path"))

    over = above.withColumnsRenamed({"tree": "_tree", "pos": "_pos"})
    groups = _gathered(nodes, level).join(over, (F.col("tree") == F.col("_tree")) & (F.col("g") == F.col("_pos")))
    rows = F.transform("items", lambda x, i: F.struct(*make(x, path(i))))
    return groups.select("tree", *[c for c in above.columns if c not in ("tree", "pos", "path")], F.explode(rows).alias("row"))


def paths(stored: list[DataFrame], above: DataFrame, make: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """Rows that `make` gives for each node of the lowest level, from `above`, the paths over each tree's own root."""
    for k in range(len(stored) - 2, 0, -1):
        above = _below(stored[k], k * SPAN, above, lambda x, p: [x["pos"].alias("pos"), p.alias("path")]).select("*", "row.pos", "row.path").drop("row")
    return _below(stored[0], 0, above, make)


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda below, s: digest(s["l"], below, s["r"]))


def manifest(documents: DataFrame) -> DataFrame:
    """One row per row of `documents`: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    The leaves of a source, by doc_id (null first; repeated ids by leaf), are a tree, and the sources' roots, null source
    first, are one more. proof_sha256 is H of the siblings from leaf to root. folded_root is worked out from the siblings
    and from the leaf, for one row in TAMPER (by CRC-32 of the id; never where it is null) from a leaf whose text is in
    lower case; verified says if it is the root. Null fields count as `-`; an empty text is `0:`. Rows that are equal in
    all five fields are leaves of their own. A tree of one leaf is its root; with one row in all, the proof is H of
    nothing. An empty table gives no rows. Other columns are not read.

    Texts are read once; from then on rows hold digests. Level 0 and every SPAN-th level above are saved; a proof reads,
    for each stored level from the top, the subtree that its leaf is in. No task holds more than some subtrees of
    FAN ** SPAN nodes, so a source with most rows is many tasks. Only the root itself comes to the driver.
    """
    of = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.crc32(of["doc_id"].cast("string").cast("binary")) % TAMPER == 0
    changed = F.when(hit, leaf(**(of | {"text": F.translate("text", UPPER, LOWER)})))
    slim = documents.select("doc_id", F.col("source").cast("string").alias("source"), leaf(**of).alias("node"), changed.alias("changed"))
    rows = in_order(saved(slim), "source", F.col("doc_id").asc_nulls_first(), F.col("node"))
    each = saved(offsets(rows, "source"))
    sources = in_order(each.groupBy("source").agg(F.lit(0).cast("long").alias("tree")), "tree", F.col("source").asc_nulls_first())
    ranks = saved(placed(sources, offsets(sources, "tree"), "tree")).select(F.col("source").alias("_source"), "pos", F.col("n").alias("m"))
    numbered = each.join(small(ranks), F.col("source").eqNullSafe(F.col("_source"))).select(*each.columns, F.col("pos").alias("tree"))
    stored = stored_levels(placed(rows, numbered, "source").select("tree", "n", "pos", "node", "doc_id", "changed"))
    subroots = stored[-1].groupBy("tree").agg(F.first("node").alias("node"))
    tops = stored_levels(ranks.join(subroots, F.col("pos") == F.col("tree")).select(F.lit(0).cast("long").alias("tree"), F.col("m").alias("n"), "pos", "node"))
    root = tops[-1].select("node").first()
    root = F.lit(root[0] if root else None).cast("string")
    nothing = F.expr("CAST(array() AS array<struct<l:string,r:string>>)")
    top = tops[-1].select("tree", "pos", nothing.alias("path"))
    if len(tops) > 1:
        over = paths(tops, top, lambda x, p: [x["pos"].alias("pos"), x["node"].alias("node"), p.alias("path")])
        over = over.select(F.col("row.pos").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("row.node").alias("subroot"), "row.path")
    else:  # one source
        over = tops[0].select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), nothing.alias("path"))
    make = lambda x, p: [x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), digest(siblings(p)).alias("proof_sha256"), folded(F.coalesce(x["changed"], x["node"]), p).alias("folded_root")]
    if len(stored) > 1:
        out = paths(stored, over, make).select("subroot", "row.*")
    else:  # all trees have one leaf
        alone = stored[0].join(over.select(F.col("tree").alias("_tree"), "subroot", "path"), F.col("tree") == F.col("_tree"))
        out = alone.select("subroot", F.inline(F.array(F.struct(*make({c: F.col(c) for c in ("doc_id", "node", "changed")}, F.col("path"))))))
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def manifest_sql(levels: int = 6, top_levels: int = 4) -> str:
    """The same rows as one statement for trees of up to 16 ** levels leaves and 16 ** top_levels sources, every level written out."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    byte = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {byte}), 4294967295)"
    ctes = [
        f"""w AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
        {leaf_sql("text")} AS leaf, CASE WHEN {crc} % {TAMPER} = 0 THEN {leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf_sql("text")} END AS fold FROM documents)""",
        "s0 AS MATERIALIZED (SELECT doc_id, tree AS source_no, leaf, tree, pos, n, fold, '' AS sib FROM w)",
        "v0 AS MATERIALIZED (SELECT tree, pos, n, leaf AS node FROM w)",
    ]

    def climb(k: int) -> None:
        ctes.append(f"r{k} AS MATERIALIZED (SELECT tree, pos // {FAN} AS pos, max(n) AS n, list(node ORDER BY pos) AS nodes FROM v{k} GROUP BY ALL)")
        ctes.append(f"v{k + 1} AS MATERIALIZED (SELECT tree, pos, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM r{k})")
        left, right = f"array_to_string(nodes[:s.pos % {FAN}], '')", f"array_to_string(nodes[s.pos % {FAN} + 2:], '')"
        ctes.append(f"""s{k + 1} AS MATERIALIZED (SELECT doc_id, source_no, leaf, s.tree, s.pos // {FAN} AS pos, (s.n + {FAN - 1}) // {FAN} AS n,
        CASE WHEN s.n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold, sib || CASE WHEN s.n > 1 THEN {left} || {right} ELSE '' END AS sib
        FROM s{k} s JOIN r{k} r ON s.tree = r.tree AND s.pos // {FAN} = r.pos)""")

    for k in range(levels):
        climb(k)
    at = levels + 1
    ctes.append(f"s{at} AS MATERIALIZED (SELECT doc_id, source_no, leaf, 0 AS tree, source_no AS pos, (SELECT count(*) FROM v{levels}) AS n, fold, sib FROM s{levels})")
    ctes.append(f"v{at} AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, (SELECT count(*) FROM v{levels}) AS n, node FROM v{levels})")
    for k in range(at, at + top_levels):
        climb(k)
    end = at + top_levels
    return f"""WITH {", ".join(ctes)} SELECT s.doc_id, s.leaf, u.node AS subroot, t.node AS root, sha256(s.sib) AS proof_sha256, s.fold AS folded_root, s.fold = t.node AS verified
    FROM s{end} s JOIN v{levels} u ON u.tree = s.source_no CROSS JOIN v{end} t"""
