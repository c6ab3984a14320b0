"""Trees as node tables (node, parent, length): ancestors, patristic distance, covariance, layout, pruning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithmesh.operators.staging import cut, running


def parse_newick(text: str) -> list[tuple[int, int | None, float, str | None]]:
    """(node, parent, branch length, label) of a Newick string; bracketed comments are skipped, a missing length is 0. Nodes
    are numbered as they open, the root being 0."""
    text = re.sub(r"\[[^\]]*\]", "", text).strip().rstrip(";")
    rows: list[list] = [[0, None, 0.0, None]]
    now, fresh = 0, 1
    for token in re.findall(r"\(|\)|,|:[^,()]+|'(?:[^']|'')*'|[^,():']+", text):
        if token == "(":
            rows.append([fresh, now, 0.0, None])
            now, fresh = fresh, fresh + 1
        elif token == ",":
            up = rows[now][1]
            rows.append([fresh, up, 0.0, None])
            now, fresh = fresh, fresh + 1
        elif token == ")":
            now = rows[now][1]
        elif token[0] == ":":
            rows[now][2] = float(token[1:])
        elif token.strip():
            name = token.strip()
            rows[now][3] = name[1:-1].replace("''", "'") if name[0] == "'" else name
    return [tuple(r) for r in rows]


def parse_nexus(text: str) -> list[tuple[int, int | None, float, str | None]]:
    """The first tree of a NEXUS file, with the labels of its translate block."""
    names = {}
    if block := re.search(r"translate(.*?);", text, re.I | re.S):
        for part in block[1].split(","):
            key, _, name = part.strip().partition(" ")
            names[key] = name.strip().strip("'")
    found = re.search(r"^\s*tree[^=]*=\s*(.*?);\s*$", text, re.I | re.M | re.S)
    if not found:
        raise ValueError("no tree in this file")
    return [(n, p, x, names.get(label, label) if label else label) for n, p, x, label in parse_newick(found[1])]


def tree_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "node long, parent long, length double, label string")


def ancestors(tree: DataFrame) -> DataFrame:
    """node, ancestor, up, steps, share: every node with itself and each ancestor, the length and the number of steps of the way up, and the product of one over
    the number of children of each node on the way. For trees (node, parent, length) of any depth: pointers to ancestors are doubled until none
    is left, so a tree of depth d takes log2(d) rounds. Lengths that are null count 0. A parent that isn't a node ends the way there."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("p")).agg((1 / F.count(F.lit(1))).alias("share"))
    known = tree.select(F.col("node").alias("p")).distinct()
    steps = tree.select("node", F.col("parent").alias("p"), F.coalesce("length", F.lit(0.0)).cast("double").alias("x")).join(kids, "p").join(known, "p", "left_semi")
    jump = cut(steps.select("node", F.col("p").alias("ancestor"), F.col("x").alias("up"), F.lit(1).alias("steps"), "share"))
    out = cut(tree.select("node", F.col("node").alias("ancestor"), F.lit(0.0).alias("up"), F.lit(0).alias("steps"), F.lit(1.0).alias("share")).distinct())
    joined = lambda low, high: low.join(high.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("up").alias("u2"), F.col("steps").alias("s2"), F.col("share").alias("h2")), "ancestor").select("node", F.col("a2").alias("ancestor"), (F.col("up") + F.col("u2")).alias("up"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("share") * F.col("h2")).alias("share"))
    nodes, reached = out.count(), 1
    while not jump.isEmpty():
        if reached > nodes:
            raise ValueError("the parents form a circle")
        out = cut(out.unionByName(joined(out, jump)))
        jump, reached = cut(joined(jump, jump)), 2 * reached
    return out


def shared_depth(tree: DataFrame, tips: DataFrame) -> DataFrame:
    """i, j, v for tips i <= j: depth of their last common ancestor below the root (the phylogenetic covariance)."""
    a = ancestors(tree)
    depth = a.groupBy("node").agg(F.max("up").alias("depth"))
    of = a.join(tips.select("node"), "node", "left_semi").select("node", "ancestor")
    pair = of.select(F.col("node").alias("i"), "ancestor").join(of.select(F.col("node").alias("j"), "ancestor"), "ancestor").where("i <= j")
    return pair.join(depth.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("i", "j").agg(F.max("depth").alias("v"))


def patristic(tree: DataFrame, tips: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """i, j, v for tips i < j: depth(i) + depth(j) - 2 shared depth. names (node, name): distances are averaged over the tips of two names."""
    s = shared_depth(tree, tips)
    d = s.where("i = j").select(F.col("i").alias("t"), F.col("v").alias("d"))
    p = s.where("i < j").join(d.select(F.col("t").alias("i"), F.col("d").alias("di")), "i").join(d.select(F.col("t").alias("j"), F.col("d").alias("dj")), "j")
    p = p.select("i", "j", (F.col("di") + F.col("dj") - 2 * F.col("v")).alias("v"))
    if names is None:
        return p
    q = p.join(names.select(F.col("node").alias("i"), F.col("name").alias("a")), "i").join(names.select(F.col("node").alias("j"), F.col("name").alias("b")), "j").where("a <> b")
    return q.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.avg("v").alias("v"))


def layout(tree: DataFrame) -> DataFrame:
    """node, parent, x, y, tip: the rectangular layout of a tree (node, parent, length) of any depth. x is the depth below the root; tips have y = 1, 2, ... in
    the order in which a walk meets them that takes children by their node number; any other node's y is the mean of its children's.

    A tip's place is 1 and, for itself and each ancestor, the tips under earlier siblings. A mean of means is the sum over the tips below, each with the product
    of one over the numbers of children on the way. An empty tree gives an empty result; null lengths count 0; several roots follow one another."""
    up = ancestors(tree)
    nodes = tree.select("node", "parent").distinct()
    tips = nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti").select("node")
    under = up.join(tips, "node", "left_semi")
    size = under.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    before = running(nodes.join(size, "node"), ["parent"], ["node"], F.col("n"), "upto").select(F.col("node").alias("ancestor"), (F.col("upto") - F.col("n")).alias("before"))
    place = under.join(before, "ancestor").groupBy("node").agg((F.sum("before") + 1).alias("place"))
    y = under.join(place, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum(F.col("share") * F.col("place")).alias("y"), (F.max("steps") == 0).alias("tip"))
    x = up.groupBy("node").agg(F.max("up").alias("x"))
    return nodes.join(x, "node").join(y, "node").select("node", "parent", "x", "y", "tip")


def elbows(places: DataFrame) -> DataFrame:
    """node, kind, x0, y0, x1, y1: the two segments of each branch of a layout: `branch` runs at the child's y from the parent's x to the child's, `stem` at the
    parent's x from the parent's y to the child's."""
    up = places.select(F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    line = lambda kind, *ends: F.struct(F.lit(kind).alias("kind"), *[e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)])
    x, y, px, py = (F.col(c) for c in ("x", "y", "px", "py"))
    both = F.array(line("branch", px, y, x, y), line("stem", px, py, px, y))
    return places.join(up, "parent").select("node", F.explode(both).alias("s")).select("node", "s.*")


def strips(places: DataFrame, groups: DataFrame) -> DataFrame:
    """run, label, first, last, y, n: contiguous runs of tips of one group (node, label) from bottom to top, with the mean y at which the group's name
    stands. Tips without a group have a null label and form runs too."""
    tips = places.where("tip").select("node", "y").join(groups.select("node", "label"), "node", "left")
    # A run begins where the tip below has another label; y has no gaps.
    below = tips.select((F.col("y") + 1).alias("y"), F.struct("label").alias("below"))
    marked = tips.join(below, "y", "left").withColumn("new", (F.col("below").isNull() | ~F.col("below.label").eqNullSafe(F.col("label"))).cast("long"))
    runs = running(marked.select("y", "label", "new"), [], ["y"], F.col("new"), "run")
    return runs.groupBy("run").agg(F.first("label").alias("label"), F.min("y").alias("first"), F.max("y").alias("last"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def pagel(cov: DataFrame, lam: float) -> DataFrame:
    """Correlation of a covariance (i, j, v), off-diagonal entries times lambda."""
    d = cov.where("i = j").select(F.col("i").alias("t"), F.sqrt("v").alias("s"))
    c = cov.join(d.select(F.col("t").alias("i"), F.col("s").alias("si")), "i").join(d.select(F.col("t").alias("j"), F.col("s").alias("sj")), "j")
    return c.select("i", "j", (F.col("v") / (F.col("si") * F.col("sj")) * F.when(F.col("i") == F.col("j"), 1.0).otherwise(lam)).alias("v"))


def pruned(tree: DataFrame, keep: DataFrame) -> DataFrame:
    """node, parent, length: the tree (node, parent, length) of the kept tips (node) alone, of any depth: other tips go, nodes with one child left are merged into it, and the root is the kept tips' last
    common ancestor, with length 0. Kept nodes that aren't tips of the tree, or aren't in it, count for nothing; one tip alone is its own root, and without any the result is empty."""
    up = ancestors(tree)
    tips = tree.select("node").distinct().join(tree.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti").join(keep.select("node").distinct(), "node", "left_semi")
    held = up.join(tips, "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()
    kids = tree.select("node", "parent").distinct().join(held, "node", "left_semi").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    stay = cut(tips.unionByName(kids.where("n > 1 and node is not null").select("node")))
    above = up.where("steps > 0").join(stay, "node", "left_semi").join(stay.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    next_ = above.groupBy("node").agg(F.min(F.struct("steps", "ancestor", "up")).alias("a"))
    return stay.join(next_, "node", "left").select("node", F.col("a.ancestor").alias("parent"), F.coalesce("a.up", F.lit(0.0)).alias("length"))


def prune(rows: list[tuple], keep: set[str]) -> list[tuple]:
    """The tree of the kept tips: others go, nodes with one child are merged into it, and the root is the kept tips' last common ancestor."""
    kids: dict = {}
    by = {r[0]: r for r in rows}
    for n, p, *_ in rows:
        if p is not None:
            kids.setdefault(p, []).append(n)
    out: list[tuple] = []

    def walk(n: int) -> list[tuple[int, float]]:
        """The kept subtree's top node and the length above it, if there is one."""
        _, _, x, label = by[n]
        if n not in kids:
            return [(n, x)] if label in keep else []
        found = [f for k in kids[n] for f in walk(k)]
        if len(found) == 1:
            return [(found[0][0], found[0][1] + x)]
        for k, y in found:
            out.append((k, n, y, by[k][3]))
        return [(n, x)] if found else []

    top = walk(next(r[0] for r in rows if r[1] is None))
    return [(top[0][0], None, 0.0, by[top[0][0]][3]), *out] if top else []
