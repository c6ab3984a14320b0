"""Routes, distances on the sphere, shortest paths by joins, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithmesh.operators.neighbours import nearest_on_sphere
from kithmesh.operators.staging import cut, ranked
from kithmesh.operators.surface import land_lengths

EARTH_M = 6378137.0
FEW_NODES = 64
BLOCK = 2048  # points j of a block
FEW = 64  # points i of a block: a task keeps the pairs of two blocks at once
SIDE = 128  # at most so many tasks for the blocks of i, and for those of j


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def route_edges(nodes: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """src, dst: consecutive nodes (id, route) of each route, and given bridge edges."""
    w = Window.partitionBy("route").orderBy("id")
    e = nodes.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null")
    return e if bridges is None else e.unionByName(bridges.select("src", "dst"))


def both_ways(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """src, dst, cost in both directions; of parallel edges the cheapest."""
    e = edges.select("src", "dst", cost).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), cost))
    return e.groupBy("src", "dst").agg(F.min(cost).alias("cost"))


def edge_costs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their great-circle length in metres as cost; nodes: id, lat, lon."""
    a = nodes.select(F.col("id").alias("src"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lat").alias("lb"), F.col("lon").alias("lp"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")).alias("cost"))


def nearest(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each point (id, lat, lon) with its nearest node and the distance in metres; ties to the smaller node; both are null for a point with a null
    coordinate. Up to FEW_NODES nodes (counted here) are sent to every task; more are searched by cells."""
    if nodes.limit(FEW_NODES + 1).count() > FEW_NODES:
        return nearest_on_sphere(points, nodes, haversine, EARTH_M)
    known = "lat is not null and lon is not null"
    n = F.broadcast(nodes.where(known).select(F.col("id").alias("node"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon")))
    d = points.where(known).select("id", "lat", "lon").crossJoin(n).select("id", "node", haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")).alias("d"))
    best = d.groupBy("id").agg(F.min(F.struct("d", "node")).alias("b"))
    return points.select("id").join(best, "id", "left").select("id", F.col("b.node").alias("node"), F.col("b.d").alias("distance"))


def _settled(old: DataFrame, new: DataFrame, keys: list[str], cost: str, also: str | None = None) -> bool:
    """No row of `new` is missing in `old`, cheaper by more than rounding, or differs in `also`."""
    was = old.select(*keys, F.col(cost).alias("_was"), *([F.col(also).alias("_as")] if also else []))
    moved = F.col("_was").isNull() | (F.col(cost) < F.col("_was") * (1 - 1e-12))
    if also:
        moved = moved | (F.col(also) != F.col("_as"))
    return new.join(was, keys, "left").where(moved).isEmpty()


def all_pairs(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """src, dst, cost of the cheapest path of every connected pair (0 to itself), by squaring in the (min, +) sense. rounds: how often
    paths are doubled; by default until no pair is new or cheaper (log2 of the longest path, and one more)."""
    e = both_ways(edges)
    ids = e.select("src").distinct()
    d = cut(e.unionByName(ids.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("cost"))).groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    k = 0
    while rounds is None or k < rounds:
        right = d.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("cost").alias("more"))
        old, d = d, cut(d.join(right, "dst").groupBy("src", F.col("end").alias("dst")).agg(F.min(F.col("cost") + F.col("more")).alias("cost")))
        k += 1
        if rounds is None and _settled(old, d, ["src", "dst"], "cost"):
            break
    return d


def path_costs(edges: DataFrame, source, rounds: int | None = None) -> DataFrame:
    """id, cost from the source by relaxations, until none makes a node reachable or cheaper, or `rounds` of them; unreachable nodes are left out."""
    e = both_ways(edges)
    stay = e.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("cost"))
    e = cut(e.unionByName(stay))  # staying costs nothing, so a round needs the costs so far only once
    d = old = stay.where(F.col("src") == source).select(F.col("src").alias("id"), F.col("cost").alias("upto"))
    k = 0
    while rounds is None or k < rounds:
        d = d.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("upto") + F.col("cost")).alias("upto"))
        k += 1
        if k % 4 == 0:
            d = cut(d)
            if rounds is None and _settled(old, d, ["id"], "upto"):
                break
            old = d
    return d.select("id", F.col("upto").alias("cost"))


def penalised_edges(edges: DataFrame, nodes: DataFrame, rings: list[list[tuple[float, float]]], penalty: float = 4.44) -> DataFrame:
    """src, dst, cost, crosses_land: edges between nodes (id, lat, lon) in both directions, each once; cost is the length of the straight line in
    metres, its part on land (rings of lon, lat) times `penalty`."""
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    a = nodes.select(F.col("id").alias("src"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    lines = e.join(a, "src").join(b, "dst").select(F.struct("src", "dst").alias("id"), "lon1", "lat1", "lon2", "lat2")
    return _measured(lines, rings, penalty).select("id.src", "id.dst", "cost", (F.col("land") > 0).alias("crosses_land"))


def _measured(lines: DataFrame, rings: list, penalty: float) -> DataFrame:
    """land, sea and cost of lines with any id: lines go by their coordinates, which repeat."""
    ends = ("lon1", "lat1", "lon2", "lat2")
    keyed = lines.withColumn("_key", F.concat_ws(",", *[F.hex(F.col(c).cast("string")) for c in ends]))
    one = keyed.groupBy("_key").agg(*[F.first(c).alias(c) for c in ends]).withColumnRenamed("_key", "id")
    found = land_lengths(one, rings, penalty)
    return keyed.join(found.withColumnRenamed("id", "_key"), "_key").select("id", "land", "sea", "cost")


def connectors(points: DataFrame, nodes: DataFrame, rings: list, penalty: float = 4.44) -> DataFrame:
    """id, node, cost (metres) of each point's penalised line to its nearest node."""
    near = nearest(points, nodes).select("id", "node")
    at = nodes.select(F.col("id").alias("node"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    lines = points.join(near, "id").join(at, "node").select(F.struct("id", "node").alias("id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2")
    return _measured(lines, rings, penalty).select("id.id", "id.node", "cost")


def network_distances(points: DataFrame, nodes: DataFrame, paths: DataFrame, rings: list, ref_lat: float, ref_lon: float, penalty: float = 4.44) -> DataFrame:
    """id, node, h1, h2, using_network (km): h1 from a point to its nearest node; h2 the smaller of h1 + path to the hub and the direct line to the
    reference point, whose nearest node is the hub. Parts of lines on land count `penalty` times; paths (src, dst, cost) are over penalised
    edges. Without a path h2 is the direct line."""
    spark = points.sparkSession
    hub = nearest(spark.createDataFrame([(0, float(ref_lat), float(ref_lon))], "id int, lat double, lon double"), nodes).first()["node"]
    near = connectors(points, nodes, rings, penalty).select("id", "node", (F.col("cost") / 1000).alias("h1"))
    lines = points.select("id", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lit(float(ref_lon)).alias("lon2"), F.lit(float(ref_lat)).alias("lat2"))
    direct = _measured(lines, rings, penalty).select("id", (F.col("cost") / 1000).alias("direct"))
    to = paths.where(F.col("dst") == hub).select(F.col("src").alias("node"), (F.col("cost") / 1000).alias("net"))
    t = near.join(to, "node", "left").join(direct, "id")
    through = F.col("h1") + F.col("net")
    return t.select("id", "node", "h1", F.least(through, F.col("direct")).alias("h2"), F.coalesce(through < F.col("direct"), F.lit(False)).alias("using_network"))


def pairwise_distances(near: DataFrame, paths: DataFrame) -> DataFrame:
    """i, j, v (km) for every ordered pair of different points: both connectors (id, node, cost) and the path between their nodes, the mean of
    the two directions; 0 where there is no path. The result has a row for each pair. Points of a node are packed in blocks, and every two blocks
    meet in a task that reads both from the shuffled files of single points, so neither pairs nor copies of points are written to disk, and a task
    holds a share of the blocks. Blocks go by cost: points at the same distance are next to each other, which a stored result keeps small."""
    near = cut(ranked(near.where("node is not null").select("id", "node", "cost"), ["cost", "id"], "at", ["node"]))
    side = max(1, min(SIDE, -(-near.count() // BLOCK)))

    def blocks(size: int, node: str, cost: str, point: str) -> DataFrame:
        packed = near.groupBy("node", F.floor((F.col("at") - 1) / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("cost").alias(cost), F.col("id").alias(point)))).alias(f"all_{point}"))
        return packed.select(F.col("node").alias(node), f"all_{point}").repartition(side)

    net = paths.select(F.col("src").alias("ni"), F.col("dst").alias("nj"), "cost")
    back = paths.select(F.col("dst").alias("ni"), F.col("src").alias("nj"), F.col("cost").alias("back"))
    # Pairs of nodes are few beside pairs of points: as a table of known size they are sent to the blocks.
    met = blocks(FEW, "ni", "ci", "i").hint("shuffle_replicate_nl").crossJoin(blocks(BLOCK, "nj", "cj", "j")).join(cut(net.join(back, ["ni", "nj"])), ["ni", "nj"], "left")
    pairs = met.select("cost", "back", "all_j", F.inline("all_i")).select("cost", "back", "ci", "i", F.inline("all_j"))
    v = F.coalesce((F.col("ci") + F.col("cj") + (F.col("cost") + F.col("back")) / 2) / 1000, F.lit(0.0))
    return pairs.where("i <> j").select("i", "j", v.alias("v"))


def traced_paths(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """src, dst, cost, path: as all_pairs, with the nodes of the cheapest path from src to dst (of equally cheap ones the smallest sequence)."""
    e = both_ways(edges)
    ids = e.select("src").distinct()
    d = cut(e.select("src", "dst", "cost", F.array("src", "dst").alias("path")).unionByName(ids.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("cost"), F.array("src").alias("path"))))
    k = 0
    while rounds is None or k < rounds:
        right = d.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("cost").alias("more"), F.slice("path", 2, 1_000_000).alias("rest"))
        best = F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), F.concat("path", "rest").alias("path"))).alias("best")
        old, d = d, cut(d.join(right, "dst").groupBy("src", F.col("end").alias("dst")).agg(best).select("src", "dst", "best.*"))
        k += 1
        if rounds is None and _settled(old, d, ["src", "dst"], "cost", "path"):
            break
    return d


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (its smallest id) of an undirected graph; labels spread and jump until nothing changes."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    lab = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = e.join(lab, e["b"] == lab["id"]).groupBy("a").agg(F.min("component").alias("m"))
        new = lab.join(near, lab["id"] == near["a"], "left").select("id", F.least("component", "m").alias("component"), (F.coalesce(F.col("m") < F.col("component"), F.lit(False))).alias("moved"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = new.join(jump, "component", "left").select("id", F.coalesce("further", "component").alias("component"), "moved")
        new = cut(new)
        if not new.where("moved").limit(1).count():
            return new.select("id", "component")
        lab = new.select("id", "component")
