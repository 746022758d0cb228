"""Parent-child links to full hierarchies by heavy-path decomposition.

Every node's links lie within its tree group (a trace). The heavy child of a node is the one with the
largest subtree; heavy links form chains, and any path to the root crosses at most log2(n) chains. A
node then is (chain, position): its depth is the depth of the chain's head plus the position, its path the
chain segments one after another, its descendants one interval of the heavy-first preorder. Nodes on a
circle of links, or below one, are separated first.

Groups of at most LOCAL_ROWS nodes go through one shuffle and are solved many at a time with vectorised
NumPy. Larger groups, of which one may hold a third of all rows, are never gathered: they are solved by
pointer doubling over the whole cluster, in a number of rounds that grows with the logarithm of the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.runtime import bounded_broadcast, cut

#: A group above this many nodes is solved over the cluster.
LOCAL_ROWS = 20_000
#: A Python task works on about this many rows at a time.
CHUNK_ROWS = 100_000
#: Most rounds of doubling: depths up to 2 ** MAX_ROUNDS.
MAX_ROUNDS = 40

COLUMNS = "root_id string, depth int, subtree_size long, head_id string, position int, preorder long"
NO_PARENT = ["", "null", "none", "nil", "n/a", "-", "0", "undefined"]


def clean_id(col: Column) -> Column:
    """Ids are compared without letter case and outer blanks."""
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def clean_parent(col: Column) -> Column:
    """A parent id; null for every spelling of 'no parent'."""
    c = clean_id(col)
    return F.when(~c.isin(*NO_PARENT) & ~c.rlike("^(0x)?0+$"), c)


def distinct_nodes(rows: DataFrame, group: list[str], node: str, parent: str) -> DataFrame:
    """One row per (group, node). Of repeated rows with different parents the smallest non-null parent counts; rows without a node id are left out."""
    return rows.where(F.col(node).isNotNull()).groupBy(*group, F.col(node).alias("node")).agg(F.min(parent).alias("parent"))


def solve(group: np.ndarray, node: np.ndarray, parent: np.ndarray, order_by: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row numbers of root and chain head, depth, subtree size, position and preorder of every row (root and head -1, depth -1 on or below a circle).

    group: codes; node, parent: strings (None for no parent). Rows are distinct in (group, node). The preorder takes siblings heavy one
    first, or by (order_by, node).
    """
    n = len(node)
    ids = pd.factorize(np.concatenate([node, parent]), use_na_sentinel=True)[0].astype(np.int64)
    wide = int(ids.max(initial=0)) + 2
    key, pkey = group * wide + ids[:n], np.where(ids[n:] < 0, -1, group * wide + ids[n:])
    up = pd.Index(key).get_indexer(pkey)
    up[pkey < 0] = -1

    # order and circle separation by doubling
    far, dist = np.where(up < 0, np.arange(n), up), (up >= 0).astype(np.int64)
    for _ in range(max(1, int(n).bit_length())):
        nxt = far[far]
        if (nxt == far).all():
            break
        dist, far = dist + dist[far], nxt
    on_tree = up[far] < 0
    depth = np.where(on_tree, dist, -1)

    # subtree sizes, deepest level first
    size = np.ones(n, np.int64)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[bounds[d] : bounds[d + 1]] for d in range(len(bounds) - 1)]
    for rows in reversed(levels[1:]):
        np.add.at(size, up[rows], size[rows])

    # heavy links: the largest child, of equals the smallest id
    inner = np.flatnonzero(depth > 0)
    rank = np.lexsort((node[inner].astype(str), -size[inner], up[inner])) if len(inner) else np.empty(0, np.int64)
    kids = inner[rank]
    first = np.ones(len(kids), bool)
    first[1:] = up[kids[1:]] != up[kids[:-1]]
    heavy = np.zeros(n, bool)
    heavy[kids[first]] = True

    head, pos, pre = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    before = np.zeros(n, np.int64)  # sizes of the siblings that come first
    if len(kids) and order_by is not None:
        kids = inner[np.lexsort((node[inner].astype(str), order_by[inner], up[inner]))]
        first = np.r_[True, up[kids[1:]] != up[kids[:-1]]]
    if len(kids):
        run = np.cumsum(size[kids]) - size[kids]
        start = np.maximum.accumulate(np.where(first, np.arange(len(kids)), 0))
        before[kids] = run - run[start]
    for rows in levels[1:]:
        h = rows[heavy[rows]]
        head[h], pos[h] = head[up[h]], pos[up[h]] + 1
        pre[rows] = pre[up[rows]] + 1 + before[rows]
    # root and depth: those of the chain's head, chain by chain down the tree of chains, and the position in the chain
    base, top = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    heads = np.flatnonzero(on_tree & (head == np.arange(n)))
    first = heads[up[heads] < 0]
    base[first], top[first] = 0, first
    heads = heads[up[heads] >= 0]
    while len(heads):  # log2(n) rounds at most
        above = head[up[heads]]
        ready = base[above] >= 0
        h = heads[ready]
        base[h], top[h] = base[above[ready]] + pos[up[h]] + 1, top[above[ready]]
        heads = heads[~ready]
    bad = ~on_tree
    root, depth = np.where(bad, -1, top[head]), np.where(bad, -1, base[head] + pos)
    head[bad], size[bad], pos[bad], pre[bad] = -1, 0, -1, -1
    return root, head, depth, size, pos, pre, up


def _paths(node: np.ndarray, head: np.ndarray, pos: np.ndarray, depth: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Full paths, root first: the prefix of a chain's head and the chain's segment up to the node."""
    out = np.full(len(node), None, object)
    order = np.lexsort((pos, head, depth - pos))
    prefix: list[str] = []
    for r in order:
        if depth[r] < 0:
            continue
        if pos[r] == 0:
            prefix = out[up[r]] if depth[r] else []
        prefix = [*prefix, node[r]]
        out[r] = prefix
    return out


def _local(nodes: DataFrame, group: list[str], with_path: bool, ordered: bool) -> DataFrame:
    schema = ", ".join([*(f"`{g}` {t}" for g, t in nodes.select(*group).dtypes), "node string, parent string, order_by long, label string", COLUMNS, *(["path array<string>"] if with_path else [])])
    k = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            f = t.to_pandas()
            code = f.groupby(group, sort=False, dropna=False).ngroup().to_numpy(np.int64)
            node, parent = f["node"].to_numpy(object), f["parent"].to_numpy(object)
            root, head, depth, size, pos, pre, up = solve(code, node, parent, f["order_by"].to_numpy(np.int64) if ordered else None)
            pick = lambda at: pa.array(np.where(at < 0, "", node[at]), pa.string())
            cols = [pick(root), pa.array(depth, pa.int32()), pa.array(size, pa.int64()), pick(head), pa.array(pos, pa.int32()), pa.array(pre, pa.int64())]
            if with_path:
                cols.append(pa.array(_paths(f["label"].to_numpy(object), head, pos, depth, up), pa.list_(pa.string())))
            names = ["root_id", "depth", "subtree_size", "head_id", "position", "preorder", "path"][: len(cols)]
            for c, v in zip(names, cols, strict=True):
                t = t.append_column(c, v)
            yield from t.to_batches(max_chunksize=10_000)

        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < CHUNK_ROWS:
                continue
            t = pa.concat_tables(held)
            last = [t.column(i)[-1].as_py() for i in range(k)]
            cut_at = t.num_rows
            while cut_at and [t.column(i)[cut_at - 1].as_py() for i in range(k)] == last:
                cut_at -= 1
            if cut_at:  # groups are sorted: the last may go on
                yield from done(t.slice(0, cut_at))
            held = [t.slice(cut_at)]
            rows = held[0].num_rows
        if rows:
            yield from done(pa.concat_tables(held))

    by_group = nodes.select(*group, "node", "parent", "order_by", "label").repartition(*group).sortWithinPartitions(*group)
    return by_group.mapInArrow(run, schema)


def running(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """rows with name, the sum of value over all rows of the same keys that come before in the order, which has to follow the bucket.

    Keys may be null and hold any number of rows: a task orders one bucket, and a bucket's offset comes from the buckets before.
    """
    rows = rows.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__total")).select(*(F.col(c).alias(f"__o_{c}") for c in keys), F.col("__bucket").alias("__o_bucket"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    same = [*(F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in keys), F.col("__bucket").eqNullSafe(F.col("__o_bucket"))]
    summed = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets.hint("merge"), same)
    return summed.withColumn(name, F.col("__inside") + F.col("__offset")).drop("__bucket", "__inside", "__offset", "__o_bucket", *(f"__o_{c}" for c in keys))


def sibling_buckets(rows: DataFrame, keys: list[str], order: str, buckets: int = 1024) -> DataFrame:
    """rows with __slot: which of so many equal stretches of the siblings' order a row lies in."""
    ends = rows.groupBy(*keys).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi")).select(*(F.col(c).alias(f"__r_{c}") for c in keys), "__lo", "__hi")
    at = rows.join(ends.hint("merge"), [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    slot = F.floor((F.col(order) - F.col("__lo")).cast("double") / (F.col("__hi") - F.col("__lo") + 1).cast("double") * buckets)
    return at.withColumn("__slot", slot).drop("__lo", "__hi", *(f"__r_{c}" for c in keys))


def _spread(nodes: DataFrame, group: list[str], with_path: bool, ordered: bool) -> DataFrame:
    """The same for groups of any size, by joins on (group, node) only."""
    key = [*group, "node"]
    # both sides of these joins grow with the data, and small files can be large tables: none is left to be broadcast
    ids = nodes.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("node").alias("__id")).hint("merge")
    is_parent = [*(F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group), F.col("parent") == F.col("__id")]
    base = nodes.join(ids, is_parent, "left").select(*key, "parent", "order_by", "label", F.col("__id").alias("up"))
    # order, roots, sizes: before round k anc is the ancestor at distance 2 ** k of the nodes that deep
    state = cut(base.select(*key, "parent", "order_by", "label", "up", F.col("up").alias("anc"), F.when(F.col("up").isNull(), F.col("node")).alias("root"), F.when(F.col("up").isNull(), 0).alias("depth"), F.lit(1).cast("long").alias("size")))
    left, step = state.where("anc is not null").count(), 1
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        u = state.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("node").alias("__id"), F.col("anc").alias("u_anc"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth")).hint("merge")
        to_anc = [*(F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group), F.col("anc") == F.col("__id")]
        add = state.where("anc is not null").groupBy(*(F.col(g).alias(f"a_{g}") for g in group), F.col("anc").alias("a_id")).agg(F.sum("size").alias("add")).hint("merge")
        to_add = [*(F.col(g).eqNullSafe(F.col(f"a_{g}")) for g in group), F.col("node") == F.col("a_id")]
        state = cut(
            state.join(u, to_anc, "left").join(add, to_add, "left").select(
                *key, "parent", "order_by", "label", "up",
                F.when(F.col("u_root").isNull(), F.col("u_anc")).alias("anc"),
                F.coalesce("root", "u_root").alias("root"),
                F.coalesce("depth", F.col("u_depth") + step).alias("depth"),
                (F.col("size") + F.coalesce("add", F.lit(0))).alias("size"),
            ),
            state,
        )
        step *= 2
        now = state.where("anc is not null").count()
        if now == left:
            break  # a round that reaches no root: what is left hangs on circles
        left = now
    tree, circles = state.where("root is not null"), state.where("root is null")

    # heavy links and chain heads
    best = tree.where("up is not null").groupBy(*(F.col(g).alias(f"h_{g}") for g in group), F.col("up").alias("h_up")).agg(F.min(F.struct((-F.col("size")).alias("s"), "node")).alias("h")).hint("merge")
    to_best = [*(F.col(g).eqNullSafe(F.col(f"h_{g}")) for g in group), F.col("up") == F.col("h_up")]
    marked = cut(tree.join(best, to_best, "left").withColumn("heavy", F.coalesce(F.col("h.node") == F.col("node"), F.lit(False))).select(*key, "parent", "order_by", "label", "up", "size", "heavy", F.coalesce(-F.col("h.s"), F.lit(0)).alias("heavy_size")))
    # how far a node's preorder is from its parent's: its earlier siblings' sizes, and one. Siblings are summed in
    # buckets, so that a node with very many children is no single task's work.
    below = marked.where("up is not null")
    if ordered:
        steps = running(sibling_buckets(below, [*group, "up"], "order_by"), [*group, "up"], F.col("__slot"), ["order_by", "node"], "size", "before").select(*key, (F.col("before") + 1).alias("gap"))
    else:  # the heavy one comes first
        light = running(below.where("not heavy"), [*group, "up"], F.pmod(F.xxhash64("node"), F.lit(1024)), ["node"], "size", "before").select(*key, (F.col("before") + F.col("heavy_size") + 1).alias("gap"))
        steps = light.unionByName(below.where("heavy").select(*key, F.lit(1).cast("long").alias("gap")))
    steps = steps.select(*(F.col(g).alias(f"g_{g}") for g in group), F.col("node").alias("g_id"), "gap").hint("merge")
    chain = cut(
        marked.join(steps, [*(F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in group), F.col("node") == F.col("g_id")], "left")
        .select(*key, "parent", "order_by", "label", "up", "size", "heavy", F.coalesce("gap", F.lit(0)).alias("gap"), F.when(F.col("heavy"), F.col("up")).otherwise(F.col("node")).alias("head"), F.when(F.col("heavy"), 1).otherwise(0).alias("pos"), F.when(F.col("heavy"), F.col("gap")).otherwise(F.lit(0)).cast("long").alias("adv")),
        marked,
    )
    for _ in range(MAX_ROUNDS):
        u = chain.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("node").alias("__id"), F.col("head").alias("u_head"), F.col("pos").alias("u_pos"), F.col("adv").alias("u_adv")).hint("merge")
        to_head = [*(F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group), F.col("head") == F.col("__id"), F.col("heavy")]
        nxt = chain.join(u, to_head, "left").withColumns({"moved": F.coalesce(F.col("u_pos"), F.lit(0)), "head": F.coalesce("u_head", "head")})
        nxt = nxt.withColumns({"pos": F.col("pos") + F.col("moved"), "adv": F.col("adv") + F.coalesce(F.col("u_adv"), F.lit(0))})
        chain = cut(nxt.drop("u_head", "u_pos", "u_adv", "__id", *(f"__{g}" for g in group)), chain)
        if chain.where("moved > 0").isEmpty():
            break

    at = chain.select(*(F.col(g).alias(f"c_{g}") for g in group), F.col("node").alias("c_id"), F.col("head").alias("c_head"), F.col("pos").alias("c_pos"), F.col("adv").alias("c_adv")).hint("merge")
    heads = chain.where("not heavy").select(*key, F.col("up").alias("link"), "gap")
    heads = heads.join(at, [*(F.col(g).eqNullSafe(F.col(f"c_{g}")) for g in group), F.col("link") == F.col("c_id")], "left").select(*group, "node", "link", "gap", "c_head", "c_pos", "c_adv")
    if with_path:
        seg = chain.groupBy(*(F.col(g).alias(f"s_{g}") for g in group), F.col("head").alias("s_head")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("segment"))
        heads = heads.join(seg, [*(F.col(g).eqNullSafe(F.col(f"s_{g}")) for g in group), F.col("node") == F.col("s_head")]).select(*group, "node", "c_head", "c_pos", "c_adv", "gap", "segment")
    else:
        heads = heads.select(*group, "node", "c_head", "c_pos", "c_adv", "gap", F.array().cast("array<string>").alias("segment"))
    heads = cut(heads)
    # resolve the tree of chains level by level: log2(n) levels at most
    level = cut(heads.where("c_head is null").select(*group, "node", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("base"), F.col("node").alias("top"), F.array().cast("array<string>").alias("prefix"), "segment"))
    levels = [level]
    for _ in range(MAX_ROUNDS):
        p = level.select(*(F.col(g).alias(f"p_{g}") for g in group), F.col("node").alias("p_node"), F.col("start").alias("p_start"), F.col("base").alias("p_base"), F.col("top").alias("p_top"), F.col("prefix").alias("p_prefix"), F.col("segment").alias("p_segment")).hint("merge")
        on_parent = [*(F.col(g).eqNullSafe(F.col(f"p_{g}")) for g in group), F.col("c_head") == F.col("p_node")]
        level = cut(heads.join(p, on_parent).select(*group, "node", (F.col("p_start") + F.col("c_adv") + F.col("gap")).alias("start"), (F.col("p_base") + F.col("c_pos") + 1).alias("base"), F.col("p_top").alias("top"), F.concat("p_prefix", F.slice("p_segment", 1, F.col("c_pos") + 1)).alias("prefix"), "segment"))
        if level.isEmpty():
            break
        levels.append(level)
    starts = levels[0]
    for x in levels[1:]:
        starts = starts.unionByName(x)
    starts = starts.select(*(F.col(g).alias(f"z_{g}") for g in group), F.col("node").alias("z_head"), "start", "base", "top", "prefix", "segment").hint("merge")
    on_head = [*(F.col(g).eqNullSafe(F.col(f"z_{g}")) for g in group), F.col("head") == F.col("z_head")]
    out = [*key, "parent", F.col("top").alias("root_id"), (F.col("base") + F.col("pos")).cast("int").alias("depth"), F.col("size").alias("subtree_size"), F.col("head").alias("head_id"), F.col("pos").cast("int").alias("position"), (F.col("start") + F.col("adv")).alias("preorder")]
    path = [F.concat("prefix", F.slice("segment", 1, F.col("pos") + 1)).alias("path")] if with_path else []
    solved = chain.join(starts, on_head).select(*out, *path)
    rest = circles.select(*key, "parent", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("subtree_size"), F.lit("").alias("head_id"), F.lit(-1).alias("position"), F.lit(-1).cast("long").alias("preorder"), *([F.lit(None).cast("array<string>").alias("path")] if with_path else []))
    return solved.unionByName(rest)


def hierarchy(nodes: DataFrame, group: list[str], with_path: bool = False, local_rows: int = LOCAL_ROWS, order: str | None = None, label: str | None = None) -> DataFrame:
    """Root, depth, subtree size, chain and preorder of every node; with_path its full path as well.

    order: a bigint column by which (then by node) the preorder takes siblings; by default the one with the largest subtree comes
    first. label: a string column that paths are made of in place of node.

    nodes: group columns, node, parent (see distinct_nodes); other columns are not read. A parent that the
    group lacks counts as none. The descendants of a node are those of its root whose preorder lies in
    (preorder, preorder + subtree_size). On or below a circle: root_id and head_id '', depth, position
    and preorder -1, no path. Empty in, empty out.
    """
    nodes = nodes.select(*group, "node", "parent", F.coalesce(F.col(order).cast("long") if order else F.lit(None), F.lit(0)).cast("long").alias("order_by"), (F.col(label).cast("string") if label else F.col("node")).alias("label"))
    args = (group, with_path, order is not None)
    large = nodes.groupBy(*group).count().where(F.col("count") > local_rows).select(*(F.col(g).alias(f"l_{g}") for g in group))
    large = cut(large)
    if large.isEmpty():
        return _local(nodes, *args).drop("order_by", "label")
    same = [F.col(g).eqNullSafe(F.col(f"l_{g}")) for g in group]
    large = bounded_broadcast(large)
    return _local(nodes.join(large, same, "left_anti"), *args).drop("order_by", "label").unionByName(_spread(nodes.join(large, same, "left_semi"), *args))


def descendants(solved: DataFrame, group: list[str], block: int = 64) -> DataFrame:
    """One row per node and descendant: group columns, node, descendant, distance.

    A node's descendants are those of its root in one interval of the preorder. The interval is cut at multiples of block, so that
    nodes meet the descendants of their own block only: the work follows the rows that come out.
    """
    at = solved.where("depth >= 0").select(*group, "root_id", "node", "depth", "preorder", "subtree_size")
    over = at.where("subtree_size > 1").select(
        *(F.col(g).alias(f"a_{g}") for g in group), F.col("root_id").alias("a_root"), "node", F.col("depth").alias("a_depth"), F.col("preorder").alias("first"), (F.col("preorder") + F.col("subtree_size")).alias("end"),
        F.explode(F.sequence(F.floor((F.col("preorder") + 1) / block), F.floor((F.col("preorder") + F.col("subtree_size") - 1) / block))).alias("a_block"),
    )
    under = at.select(*group, "root_id", F.col("node").alias("descendant"), "depth", "preorder", F.floor(F.col("preorder") / block).alias("block"))
    same = [*(F.col(g).eqNullSafe(F.col(f"a_{g}")) for g in group), F.col("root_id") == F.col("a_root"), F.col("block") == F.col("a_block"), F.col("preorder") > F.col("first"), F.col("preorder") < F.col("end")]
    return under.join(over, same).select(*group, "node", "descendant", (F.col("depth") - F.col("a_depth")).alias("distance"))
