"""Parent-child rows to full hierarchies (problem 3).

Subtree sizes are computed upward and preorder positions are allotted downward
by prefix sums over siblings; ancestors and descendants then follow from
nested-set ranges (``pos <= x < pos + size``): the root is the one whose range
holds the node, the depth the number of ranges that are open at its position,
the number of descendants the length of its own range less one.

Both passes use pointer doubling, so a tree of depth d takes log2(d) rounds
rather than d:

* upward, ``size`` after round k counts the nodes less than 2^k below; adding
  the sizes of the nodes whose 2^k-th ancestor one is doubles the reach;
* downward, each node's offset within its parent is known from the sizes and
  the prefix sum over its siblings; summing offsets along the ancestor
  pointers gives the preorder position.

Nodes whose pointer never reaches a root are the unprocessed ones: they are on
or below a loop. The loop itself is what remains of the images of the pointer
map; its edges are cut to measure what hangs below it.

Every round is a keyed join and a keyed aggregation with map-side combine,
written to the shared folder to cut lineage. Prefix sums are taken over
ranges of (parent, id), so a parent of a third of all nodes, or the set of all
roots, is spread over many tasks. A table counted at up to ``ONE_TASK`` nodes is
done in one task by the same passes, level by level, with the same result.

Siblings are ordered by id. Defined results: a null or blank id is left out; a parent that is null, blank
or not in the table makes a root of depth 0; repeated ids are reduced to one
row before (``latest_per_key``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

#: Nodes up to which one task takes all rounds (some 100 MB there).
ONE_TASK = 200_000


def _resolve(nodes: DataFrame) -> DataFrame:
    """(id, parent): parents that are not ids become null."""
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return nodes.select("id", "parent").join(ids, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _advance(state: DataFrame, carried: dict[str, tuple[str, str]]) -> DataFrame:
    """One doubling: replace ``ptr`` by the pointer's pointer.

    ``carried``: column -> (the target's column, "sum" or "min"), how the value
    at the pointer is folded into the own.
    """
    target = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), *[F.col(src).alias(f"t_{c}") for c, (src, _) in carried.items()])
    joined = state.join(target, "ptr", "left")
    out = []
    for c in state.columns:
        if c == "ptr":
            out.append(F.col("ptr2").alias("ptr"))
        elif c in carried:
            own, there, how = F.col(c), F.col(f"t_{c}"), carried[c][1]
            out.append({"sum": own + F.coalesce(there, F.lit(0)), "min": F.least(own, there)}[how].alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def _unprocessed(edges: DataFrame, label: str) -> DataFrame:
    """(id, ptr) of the nodes that never reach a root, ptr far up their path.

    The number with a pointer stops falling exactly when only those remain: a
    node of depth 2^(k+1) or more has an ancestor whose depth is in
    [2^k, 2^(k+1)), which drops out in round k.
    """
    state = materialize(edges.select("id", F.col("parent").alias("ptr")).where(F.col("ptr").isNotNull()), f"{label}-ptr")
    left = state.count()
    while left:
        # Nodes without a pointer are gone from the state: a missing target ends the path.
        state = materialize(_advance(state, {}).where(F.col("ptr").isNotNull()), f"{label}-ptr")
        now = state.count()
        if now == left:
            break
        left = now
    return state


def _loop_nodes(state: DataFrame) -> DataFrame:
    """(id) of the nodes on a loop: the images of far pointers, until they stop shrinking."""
    image = materialize(state.select(F.col("ptr").alias("id")).distinct(), "loop")
    count = image.count()
    while True:
        state = materialize(_advance(state, {}), "loop-ptr")
        smaller = materialize(state.select(F.col("ptr").alias("id")).distinct(), "loop")
        now = smaller.count()
        if now == count:
            return smaller
        count = now


def _loop_labels(edges: DataFrame, on_loop: DataFrame) -> DataFrame:
    """(id, loop): the smallest id of the loop each loop node is on."""
    state = materialize(edges.join(on_loop, "id", "left_semi").select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("loop")), "loop-min")
    while True:
        step = materialize(_advance(state, {"loop": ("loop", "min")}), "loop-min")
        # Windows of 2^k nodes have the minimum of windows of 2^(k+1) everywhere: it is the loop's.
        changed = step.select("id", F.col("loop").alias("new")).join(state.select("id", "loop"), "id").where(F.col("new") != F.col("loop")).limit(1).count()
        if not changed:
            return step.select("id", "loop")
        state = step


def _sizes(edges: DataFrame) -> DataFrame:
    """(id, size) of a forest, by upward doubling."""
    state = materialize(edges.select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size")), "forest")
    while True:
        moving = state.where(F.col("ptr").isNotNull())
        if not moving.limit(1).count():
            return state.select("id", "size")
        below = moving.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("below"))
        up = moving.join(state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2")), "ptr", "left").select("id", F.col("ptr2").alias("ptr"), "size")
        rest = state.where(F.col("ptr").isNull())
        state = materialize(up.unionByName(rest.select(*up.columns)).join(below, "id", "left").select("id", "ptr", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), "forest")


def _running(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in the order of ``by`` over the whole table: one row per range is summed in one task."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), name)
    totals = placed.groupBy("range").agg(F.sum(value).alias("in_range"))
    starts = totals.select("range", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("here", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(F.broadcast(starts), "range").withColumn(name, (F.col("here") + F.col("start")).cast("long")).drop("range", "here", "start")


def _positions(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, parent, size, pos): preorder position, unique over the whole forest.

    Roots are siblings of one another, so the forest is numbered 0..n-1.
    """
    kids = edges.join(sizes, "id").select("id", "parent", "size")
    summed = materialize(_running(kids, ["parent", "id"], "size", "before"), "siblings")
    # The sum before a parent's first child is taken off; a child starts one after its parent.
    first = summed.groupBy(F.col("parent").alias("of")).agg(F.min("before").alias("base"))
    offset = F.col("before") - F.col("base") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    state = materialize(summed.join(first, F.col("parent").eqNullSafe(F.col("of"))).select("id", F.col("parent").alias("ptr"), offset.cast("long").alias("pos")), "preorder")
    while state.where(F.col("ptr").isNotNull()).limit(1).count():
        state = materialize(_advance(state, {"pos": ("pos", "sum")}), "preorder")
    return kids.join(state.select("id", "pos"), "id")


def _from_ranges(ranges: DataFrame) -> DataFrame:
    """(id, parent, size, pos, root, depth): the number of open ranges at each position, and the root's that is one of them."""
    opened = ranges.select("id", "parent", "size", "pos", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("open"))
    closed = ranges.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("pos"), (F.col("pos") + F.col("size")).alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("open"))
    # Ranges that end at a position are closed before the one that begins there.
    closing = closed.groupBy("id", "parent", "size", "pos", "at", "kind").agg(F.sum("open").alias("open"))
    depths = _running(opened.unionByName(closing), ["at", "kind"], "open", "depth").where(F.col("kind") == 1)
    # A root's range is cut at block borders, so that its nodes find it by their block.
    width = 4096
    roots = ranges.where(F.col("parent").isNull()).select(F.col("id").alias("root"), F.col("pos").alias("lo"), (F.col("pos") + F.col("size") - 1).alias("hi"))
    split = roots.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    found = depths.withColumn("block", F.floor(F.col("pos") / width)).join(split, "block").where((F.col("pos") >= F.col("lo")) & (F.col("pos") <= F.col("hi")))
    return found.select("id", "parent", "size", "pos", "root", "depth")


# --- One task -------------------------------------------------------------------

_OUT = "id string, parent string, root string, depth long, n_descendants long, size long, pos long"


def ranges_of(ids: list[str], parents: list[str | None]) -> tuple[np.ndarray, ...]:
    """(root number, depth, n_descendants, size, pos) of each node; -1 for no root, depth, size and position.

    The same passes level by level: leaves are peeled off upward, which leaves
    the loops; positions are allotted downward.
    """
    n = len(ids)
    number = {x: k for k, x in enumerate(ids)}
    up = np.array([number.get(p, -1) if p is not None else -1 for p in parents], np.int64)
    size = np.ones(n, np.int64)
    waiting = np.bincount(up[up >= 0], minlength=n)
    levels, level, peeled = [], np.flatnonzero(waiting == 0), np.zeros(n, bool)
    while len(level):
        peeled[level] = True
        levels.append(level)
        own = level[up[level] >= 0]
        np.add.at(size, up[own], size[own])
        np.subtract.at(waiting, up[own], 1)
        touched = np.unique(up[own])
        level = touched[waiting[touched] == 0]
    below = size - 1
    # What is left is on a loop; each node of one reaches all that the loop carries.
    looped = ~peeled
    label = np.full(n, -1, np.int64)
    for k in np.flatnonzero(looped).tolist():
        if label[k] < 0:
            ring = [k]
            while up[ring[-1]] != k:
                ring.append(int(up[ring[-1]]))
            label[ring] = k
            below[ring] = int(size[ring].sum()) - 1
    # Downward in the order of ids: a node's offset is what its earlier siblings take.
    order = np.lexsort((np.array(ids, dtype=object).astype(str), up))
    before = np.cumsum(size[order]) - size[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(up[order]) != 0])) if n else np.empty(0, np.int64)
    base = np.repeat(before[starts], np.diff(np.concatenate([starts, [n]])))
    offset = np.empty(n, np.int64)
    offset[order] = before - base
    # Roots' siblings are the roots that head trees.
    root, depth, pos = (np.full(n, -1, np.int64) for _ in range(3))
    tops = order[(up[order] < 0)]
    root[tops], depth[tops], pos[tops] = tops, 0, offset[tops]
    for level in reversed(levels):
        own = level[up[level] >= 0]
        own = own[root[up[own]] >= 0]
        root[own], depth[own] = root[up[own]], depth[up[own]] + 1
        pos[own] = pos[up[own]] + 1 + offset[own]
    return root, depth, below, np.where(root >= 0, size, -1), pos


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    ids, parents = whole.column("id").to_pylist(), whole.column("parent").to_pylist()
    known = set(ids)
    parents = [p if p in known else None for p in parents]
    root, depth, below, size, pos = ranges_of(ids, parents)
    columns = {"id": pa.array(ids), "parent": pa.array(parents, pa.string()), "root": pa.array([ids[r] if r >= 0 else "" for r in root.tolist()]), "depth": pa.array(depth), "n_descendants": pa.array(below), "size": pa.array(size, mask=root < 0), "pos": pa.array(pos, mask=root < 0)}
    yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=20_000)


def hierarchy(nodes: DataFrame) -> DataFrame:
    """(id, parent, root, depth, n_descendants, size, pos) for each id.

    ``nodes``: (id, parent), ids unique. On or below a loop, root is '', depth
    is -1, and pos and size are null; n_descendants then counts the distinct
    other nodes reached downwards: below the loop its subtree, on it all that
    the loop carries.
    """
    given = materialize(nodes.where(F.col("id").isNotNull()).select("id", "parent"), "nodes")
    if given.count() <= ONE_TASK:
        return materialize(given.coalesce(1).mapInArrow(_one_task, _OUT), "levels")
    edges = materialize(_resolve(given), "edges")
    far = _unprocessed(edges, "all")
    if not far.limit(1).count():
        return _from_ranges(materialize(_positions(edges, _sizes(edges)), "ranges")).select("id", "parent", "root", "depth", (F.col("size") - 1).alias("n_descendants"), "size", "pos")
    on_loop = _loop_nodes(far)
    cut = edges.join(on_loop.withColumn("on_loop", F.lit(True)), "id", "left")
    forest = materialize(cut.select("id", F.when(F.col("on_loop").isNull(), F.col("parent")).alias("parent")), "forest-edges")
    sizes = materialize(_sizes(forest), "sizes")
    loops = _loop_labels(edges, on_loop)
    carried = loops.join(sizes, "id").groupBy("loop").agg((F.sum("size") - 1).alias("on_n"))
    marks = loops.join(carried, "loop").select("id", "on_n")
    cyclic = far.select("id").join(edges, "id").join(sizes, "id").join(marks, "id", "left")
    below = cyclic.select("id", "parent", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), F.coalesce("on_n", F.col("size") - 1).alias("n_descendants"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("pos"))
    trees = materialize(edges.join(far.select("id"), "id", "left_anti"), "trees")
    ranges = materialize(_positions(trees, sizes), "ranges")
    return _from_ranges(ranges).select("id", "parent", "root", "depth", (F.col("size") - 1).alias("n_descendants"), "size", "pos").unionByName(below)


def paths(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """(id, path): ids from the root down to the node; [] on or below a loop.

    ``levels``: what ``hierarchy`` returned. Doubled like the rest: a round
    puts the path of the 2^k-th ancestor before the own.
    """
    trees = levels.where(F.col("depth") >= 0)
    state = materialize(trees.select("id", F.when(F.col("depth") > 0, F.col("parent")).alias("ptr"), F.array("id").alias("path")), "path")
    while state.where(F.col("ptr").isNotNull()).limit(1).count():
        target = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("path").alias("t_path"))
        state = materialize(state.join(target, "ptr", "left").select("id", F.col("ptr2").alias("ptr"), F.when(F.col("t_path").isNotNull(), F.concat("t_path", "path")).otherwise(F.col("path")).alias("path")), "path")
    empty = levels.where(F.col("depth") < 0).select("id", F.array().cast("array<string>").alias("path"))
    return state.select("id", "path").unionByName(empty)


def descendants(levels: DataFrame, of: DataFrame, width: int = 4096) -> DataFrame:
    """(ancestor, id) for the ids in ``of``: nested-set ranges as a range join.

    Positions are cut into blocks of ``width``; a range is split at block
    borders, so the join is an equi-join on the block with a range condition
    and no cross product. Nodes on or below loops have no range and give none.
    """
    ranges = of.select("id").join(levels, "id").where(F.col("size") > 1).select(F.col("id").alias("ancestor"), F.col("pos").alias("lo"), (F.col("pos") + F.col("size") - 1).alias("hi"))
    split = ranges.withColumn("block", F.explode(F.sequence(F.floor((F.col("lo") + 1) / width), F.floor(F.col("hi") / width))))
    at = levels.where(F.col("pos").isNotNull()).select("id", "pos", F.floor(F.col("pos") / width).alias("block"))
    return split.join(at, "block").where((F.col("pos") > F.col("lo")) & (F.col("pos") <= F.col("hi"))).select("ancestor", "id")


def all_descendants(levels: DataFrame, width: int = 4096) -> DataFrame:
    """(ancestor, id) for every id, loops included: the distinct other ids reached downwards.

    Trees by their ranges. A loop is cut at each of its nodes, which gives
    ranges to what hangs below it; a node on it reaches all that the others carry.
    """
    found = descendants(levels, levels, width)
    edges = materialize(levels.where(F.col("depth") < 0).select("id", "parent"), "loop-edges")
    if not edges.limit(1).count():
        return found
    on_loop = _loop_nodes(_unprocessed(edges, "loops"))
    loops = materialize(_loop_labels(edges, on_loop), "loops")
    mark = loops.select("id", F.lit(True).alias("on_loop"))
    cut = edges.join(mark, "id", "left").select("id", F.when(F.col("on_loop").isNull(), F.col("parent")).alias("parent"))
    below = materialize(hierarchy(cut), "loop-levels")
    carried = below.select("id", "root").join(loops.select(F.col("id").alias("root"), "loop"), "root")
    around = loops.select(F.col("id").alias("ancestor"), "loop").join(carried, "loop").where(F.col("ancestor") != F.col("root")).select("ancestor", "id")
    return found.unionByName(descendants(below, below, width)).unionByName(around)
