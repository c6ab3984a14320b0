"""Queries of trees, meshes and clusters, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithmesh.operators import cluster, graph, mesh, relational, surface, tree
from kithmesh.plans.catalog import _NET, _PATR, _WEDGES, _Tables, _edges, _nodes, _point, _query, _ratios, _sql_hav, _sql_point, _suppliers, _tips, _tree

# --- a tree of five levels: the world, regions, nations, segments, customers ----------------------------------------------------

_DEEP = """WITH c AS (SELECT c_custkey AS k, n_nationkey AS n, n_regionkey AS r, ascii(c_mktsegment) AS s, 0.5 + c_custkey % 9 * 0.125 AS own FROM customer JOIN nation ON c_nationkey = n_nationkey),
tree AS (SELECT -1::BIGINT AS node, NULL::BIGINT AS parent, 0.0::DOUBLE AS length UNION ALL SELECT DISTINCT -10 - r, -1, 1.0 + r * 0.25 FROM c UNION ALL SELECT DISTINCT -1000 - n, -10 - r, 0.75 + n % 3 * 0.25 FROM c
  UNION ALL SELECT DISTINCT -100000 - n * 1000 - s, -1000 - n, 0.5 + s % 2 * 0.5 FROM c UNION ALL SELECT k, -100000 - n * 1000 - s, own FROM c),
"""
_LAYOUT = _DEEP.replace("WITH c", "WITH RECURSIVE c", 1) + """kids AS (SELECT parent, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent),
walk AS (SELECT node, parent, [node] AS path, length AS x, 1 AS level FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, t.parent, list_append(w.path, t.node), w.x + t.length, level + 1 FROM walk w JOIN tree t ON t.parent = w.node),
tips AS (SELECT node, parent, row_number() OVER (ORDER BY path) AS y FROM walk WHERE node NOT IN (SELECT parent FROM kids)),
up AS (SELECT node, parent, y::DOUBLE AS y, level FROM tips JOIN walk USING (node, parent) UNION ALL SELECT w.node, w.parent, m.y, w.level FROM (SELECT parent AS node, sum(y) / max(n) AS y, max(level) AS was FROM up JOIN kids USING (parent) GROUP BY parent) m JOIN walk w USING (node) WHERE m.was = w.level + 1),
lay AS (SELECT w.node, w.parent, w.x, u.y, t.node IS NOT NULL AS tip FROM walk w JOIN up u USING (node) LEFT JOIN tips t ON t.node = w.node)"""


def _deep(t: _Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"), F.ascii("c_mktsegment").alias("s"))
    nation, segment = -1000 - F.col("n"), -100000 - F.col("n") * 1000 - F.col("s")
    region = -10 - F.col("r")
    row = lambda node, parent, length: c.select(node.cast("long").alias("node"), parent.cast("long").alias("parent"), length.cast("double").alias("length")).distinct()
    root = t.spark.range(1).select(F.lit(-1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("length"))
    levels = [row(region, F.lit(-1), 1.0 + F.col("r") * 0.25), row(nation, region, 0.75 + F.col("n") % 3 * 0.25), row(segment, nation, 0.5 + F.col("s") % 2 * 0.5), row(F.col("k"), segment, 0.5 + F.col("k") % 9 * 0.125)]
    for x in levels:
        root = root.unionByName(x)
    return root


@_query(_LAYOUT + " SELECT node, parent, round(x, 9) AS x, round(y, 9) AS y, tip FROM lay")
def tree_layout(t):
    return tree.layout(_deep(t))


@_query(_LAYOUT + """ SELECT c.node, s.kind, round(s.x0, 9) AS x0, round(s.y0, 9) AS y0, round(s.x1, 9) AS x1, round(s.y1, 9) AS y1 FROM (SELECT c.node, unnest([{'kind': 'branch', 'x0': p.x, 'y0': c.y, 'x1': c.x, 'y1': c.y}, {'kind': 'stem', 'x0': p.x, 'y0': p.y, 'x1': p.x, 'y1': c.y}]) AS s FROM lay c JOIN lay p ON c.parent = p.node) c""")
def tree_elbows(t):
    return tree.elbows(tree.layout(_deep(t)))


@_query(_LAYOUT + """, b AS (SELECT y, (node % 7) // 3 AS label, lag((node % 7) // 3) OVER (ORDER BY y) IS DISTINCT FROM (node % 7) // 3 AS new FROM lay WHERE tip), r AS (SELECT *, sum(new::BIGINT) OVER (ORDER BY y) AS run FROM b)
SELECT run::BIGINT AS run, any_value(label)::BIGINT AS label, min(y) AS first, max(y) AS last, round(avg(y), 9) AS y, count(*) AS n FROM r GROUP BY run""")
def tree_strips(t):
    groups = t.customer.select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") % 7 / 3).alias("label"))
    return tree.strips(tree.layout(_deep(t)), groups)


@_query(_LAYOUT + """, kt AS (SELECT t.node, w.path, w.x FROM tips t JOIN walk w USING (node) WHERE t.node % 11 < 2), held AS (SELECT DISTINCT unnest(path) AS node FROM kt),
stay AS (SELECT node FROM kt UNION SELECT parent FROM tree SEMI JOIN held USING (node) WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1),
above AS (SELECT s.node, unnest(w.path[1:-2]) AS up, generate_subscripts(w.path[1:-2], 1) AS k FROM stay s JOIN walk w USING (node)), best AS (SELECT node, arg_max(up, k) AS parent FROM above WHERE up IN (SELECT node FROM stay) GROUP BY node)
SELECT s.node, b.parent, round(coalesce(w.x - p.x, 0), 9)::DOUBLE AS length FROM stay s LEFT JOIN best b USING (node) JOIN walk w ON w.node = s.node LEFT JOIN walk p ON p.node = b.parent""")
def tree_pruned(t):
    return tree.pruned(_deep(t), t.customer.where("c_custkey % 11 < 2").select(F.col("c_custkey").alias("node")))


@_query(_PATR.replace("WITH p AS", "WITH d AS (WITH p AS", 1) + "), n AS (SELECT n_nationkey::BIGINT AS id, 'g' || n_nationkey % 4 AS name FROM nation) SELECT least(a.name, b.name) AS i, greatest(a.name, b.name) AS j, round(avg(v), 9) AS v FROM d JOIN n a ON a.id = d.i JOIN n b ON b.id = d.j WHERE a.name <> b.name GROUP BY ALL")
def patristic_by_name(t):
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), F.concat(F.lit("g"), (F.col("n_nationkey") % 4).cast("string")).alias("name"))
    return tree.patristic(_tree(t), _tips(t), names)


@_query(_NET + """SELECT 'main' AS kind, src::VARCHAR AS src, dst::VARCHAR AS dst, round(a.lon, 9) AS lon1, round(a.lat, 9) AS lat1, round(b.lon, 9) AS lon2, round(b.lat, 9) AS lat2, FALSE AS arrow, NULL::VARCHAR AS grp FROM e JOIN nd a ON a.id = src JOIN nd b ON b.id = dst
UNION ALL SELECT 'connector', id::VARCHAR, node::VARCHAR, round(sup.lon, 9), round(sup.lat, 9), round(n.lon, 9), round(n.lat, 9), TRUE, CASE WHEN s_acctbal > 4500 THEN 'above' ELSE 'below' END FROM sup JOIN nn USING (id) JOIN nd n ON n.id = node JOIN supplier ON s_suppkey = sup.id""")
def network_figure(t):
    points = _suppliers(t).join(t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 4500, "above").otherwise("below").alias("side")), "id")
    return relational.drawn_network(_edges(t), _nodes(t), points, graph.nearest(_suppliers(t), _nodes(t)), "side")


# --- meshes within the regions' land -----------------------------------------------------------------------------------------------

#: A region's land, from its south-west corner: a ring with a bay, and a lake.
_SHORE = [(0.0, 0.0), (1.7, 0.45), (1.3, 3.9), (1.95, 7.1), (0.35, 6.6), (0.65, 3.2)]
_LAKE = [(0.75, 1.1), (1.15, 1.35), (0.85, 2.3)]
_STEP, _COLS, _ROWS = 0.5, 90, 120


def _rings(t: _Tables) -> DataFrame:
    corners = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).alias("ord"), F.lit(x).alias("x"), F.lit(y).alias("y")) for part, ring in enumerate((_SHORE, _LAKE)) for k, (x, y) in enumerate(ring)])
    r = t.region.select(F.col("r_regionkey").cast("long").alias("region"), F.explode(corners).alias("c"))
    return r.select("region", "c.part", "c.ord", (116 + 2.5 * F.col("region") + F.col("c.x")).alias("lon"), (6 + F.col("region") + F.col("c.y")).alias("lat"))


def _customers(t: _Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), *_point("c_custkey"))


_SIDES = ", ".join(f"({p}, {x1}, {y1}, {x2}, {y2})" for p, ring in enumerate((_SHORE, _LAKE)) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))
_LAND = f"""side AS (SELECT r_regionkey::BIGINT AS region, 116 + 2.5::DOUBLE * r_regionkey + a::DOUBLE AS x1, 6 + r_regionkey + b::DOUBLE AS y1, 116 + 2.5::DOUBLE * r_regionkey + c::DOUBLE AS x2, 6 + r_regionkey + d::DOUBLE AS y2 FROM region, (VALUES {_SIDES}) s(part, a, b, c, d))"""


def _sql_within(points: str) -> str:
    """(id, region) of points, by the exact ray test with every side."""
    return f"SELECT p.id, s.region FROM {points} p JOIN side s ON (s.y1 > p.lat) <> (s.y2 > p.lat) AND p.lon < (s.x2 - s.x1) * (p.lat - s.y1) / (s.y2 - s.y1) + s.x1 GROUP BY p.id, s.region HAVING count(*) % 2 = 1"


_MESH = f"""{_LAND}, box AS (SELECT min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM side), size AS (SELECT *, floor((x1 - x0) / {_STEP}::DOUBLE)::BIGINT + 1 AS cols, floor((y1 - y0) / ({_STEP}::DOUBLE * {mesh.ROW!r}::DOUBLE))::BIGINT + 1 AS rows FROM box),
every AS (SELECT i AS id, i % cols AS c, i // cols AS r, x0 + (i % cols + i // cols % 2 * 0.5::DOUBLE) * {_STEP}::DOUBLE AS lon, y0 + i // cols * ({_STEP}::DOUBLE * {mesh.ROW!r}::DOUBLE) AS lat, cols FROM size, (SELECT unnest(range(100000))::BIGINT AS i) WHERE i < cols * rows),
node AS (SELECT * FROM every WHERE id IN (SELECT id FROM ({_sql_within("every")}))),
edge AS (SELECT a.id AS src, b.id AS dst FROM node a JOIN node b ON (b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c IN (a.c + a.r % 2, a.c + a.r % 2 - 1)))"""


@_query(f"WITH {_LAND}, p AS (SELECT c_custkey AS id, {_sql_point('c_custkey')} FROM customer) {_sql_within('p')}")
def points_in_polygons(t):
    return mesh.within(_customers(t), _rings(t))


@_query(f"WITH {_MESH} SELECT id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM node")
def mesh_nodes(t):
    return mesh.clipped_lattice(_rings(t), _STEP)[0]


@_query(f"WITH {_MESH} SELECT src, dst FROM edge")
def mesh_edges(t):
    return mesh.clipped_lattice(_rings(t), _STEP)[1]


# A hull's side has every node on its left or on it; a point is inside if it lies left of all of them.
@_query(f"""WITH RECURSIVE {_MESH}, p AS (SELECT s_suppkey AS id, {_sql_point('s_suppkey')} FROM supplier), ways AS (SELECT src AS a, dst AS b FROM edge UNION ALL SELECT dst, src FROM edge),
reach AS (SELECT id AS a, id AS b FROM node UNION SELECT r.a, ways.b FROM reach r JOIN ways ON ways.a = r.b), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
far AS (SELECT r, min(lon) AS lo, max(lon) AS hi, max(lat) AS lat FROM node GROUP BY r), rim AS (SELECT lo AS lon, lat FROM far UNION SELECT hi, lat FROM far),
rim_side AS (SELECT a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_ FROM rim a JOIN rim b ON a.lon <> b.lon OR a.lat <> b.lat WHERE NOT EXISTS (SELECT 1 FROM rim c WHERE (b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon) < -1e-12)),
lost AS (SELECT id FROM p WHERE EXISTS (SELECT 1 FROM rim_side WHERE (bx - ax) * (lat - ay) <= (by_ - ay) * (lon - ax))),
near AS (SELECT p.id, arg_min(n.id, {{'d': {_sql_hav('p', 'n')}, 'n': n.id}}) AS node FROM p CROSS JOIN node n GROUP BY p.id), occ AS (SELECT node, count(*) AS n FROM near GROUP BY node)
SELECT (SELECT count(*) FROM node) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges, (SELECT count(DISTINCT c) FROM comp) AS n_components, (SELECT count(*) FROM lost) AS n_stranded, count(*) AS n_occupied, max(n) AS most, median(n)::DOUBLE AS median FROM occ""")
def mesh_report(t):
    nodes, edges = mesh.clipped_lattice(_rings(t), _STEP)
    return mesh.mesh_report(nodes, edges, _suppliers(t), graph.nearest(_suppliers(t), nodes))


@_query(_WEDGES + f""", {_MESH}, nv AS (SELECT n_nationkey::BIGINT AS id, coalesce(v, 0) AS value, {_sql_point('n_nationkey')} FROM nation LEFT JOIN (SELECT id, avg(lr) AS v FROM (SELECT src AS id, lr FROM r UNION ALL SELECT dst, lr FROM r) GROUP BY id) ON id = n_nationkey),
val AS (SELECT node.id, node.lon, node.lat, arg_min(nv.value, {{'d': {_sql_hav('node', 'nv')}, 'n': nv.id}}) AS v FROM node CROSS JOIN nv GROUP BY node.id, node.lon, node.lat),
link AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM edge), tri AS (SELECT ab.a, ab.b, ac.b AS c FROM link ab JOIN link ac ON ab.a = ac.a JOIN link bc ON bc.a = ab.b AND bc.b = ac.b),
cor AS (SELECT tri.a, tri.b, tri.c, x.lon AS xa, x.lat AS ya, x.v AS va, y.lon AS xb, y.lat AS yb, y.v AS vb, z.lon AS xc, z.lat AS yc, z.v AS vc, (y.lat - z.lat) * (x.lon - z.lon) + (z.lon - y.lon) * (x.lat - z.lat) AS det FROM tri JOIN val x ON x.id = tri.a JOIN val y ON y.id = tri.b JOIN val z ON z.id = tri.c),
grid AS (SELECT i * {_COLS} + j AS id, x0 + j * ((x1 - x0) / {_COLS - 1}) AS lon, y0 + i * ((y1 - y0) / {_ROWS - 1}) AS lat FROM box, (SELECT unnest(range({_ROWS}))::BIGINT AS i), (SELECT unnest(range({_COLS}))::BIGINT AS j)),
bary AS (SELECT g.id, g.lon, g.lat, a, b, c, ((yb - yc) * (lon - xc) + (xc - xb) * (lat - yc)) / det AS p, ((yc - ya) * (lon - xc) + (xa - xc) * (lat - yc)) / det AS q, va, vb, vc FROM grid g JOIN cor ON lon BETWEEN least(xa, xb, xc) - 1e-9 AND greatest(xa, xb, xc) + 1e-9 AND lat BETWEEN least(ya, yb, yc) - 1e-9 AND greatest(ya, yb, yc) + 1e-9),
hit AS (SELECT id, lon, lat, arg_min(p * va + q * vb + (1 - p - q) * vc, {{'a': a, 'b': b, 'c': c}}) AS value FROM bary WHERE p >= -1e-9 AND q >= -1e-9 AND p + q <= 1 + 1e-9 GROUP BY id, lon, lat)
SELECT round(lon, 9) AS lon, round(lat, 9) AS lat, round(value, 9) AS value FROM hit WHERE id IN (SELECT id FROM ({_sql_within("grid")}))""")
def mesh_raster(t):
    nodes, edges = mesh.clipped_lattice(_rings(t), _STEP)
    of = surface.node_values(_ratios(t), _nodes(t)).select(F.col("id").alias("node"), F.coalesce("value", F.lit(0.0)).alias("value"))
    values = graph.nearest(nodes, _nodes(t)).join(of, "node").select("id", "value")
    return mesh.surface_raster(nodes, edges, values, _rings(t), _COLS, _ROWS)


# Each region is a square of two triangles, with corners valued by its key, name and nations.
@_query("""WITH r AS (SELECT r_regionkey::BIGINT AS r, r_regionkey + 1.0::DOUBLE AS a, length(r_name)::DOUBLE AS b, count(n_nationkey)::DOUBLE AS c, min(n_nationkey)::DOUBLE AS d FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
g AS (SELECT i * 0.1::DOUBLE AS lon, j * 0.1::DOUBLE AS lat FROM (SELECT unnest(range(101)) AS i), (SELECT unnest(range(21)) AS j)), p AS (SELECT g.*, r.*, lon - 2 * r AS u FROM g JOIN r ON lon >= 2 * r - 1e-9 AND lon <= 2 * r + 2 + 1e-9),
v AS (SELECT lon, lat, arg_min(CASE WHEN u + lat <= 2 + 1e-9 THEN a + u / 2 * (b - a) + lat / 2 * (c - a) ELSE d + (2 - lat) / 2 * (b - d) + (2 - u) / 2 * (c - d) END, r) AS v FROM p GROUP BY lon, lat)
SELECT round(lon, 9) AS lon, round(lat, 9) AS lat, round(v, 9) AS value FROM v""")
def raster_grid(t):
    r = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_regionkey").cast("long").alias("r"), "r_name").agg(F.count("n_nationkey").alias("c"), F.min("n_nationkey").alias("d"))
    west, zero, two = 2.0 * F.col("r"), F.lit(0.0), F.lit(2.0)
    a, b, c, d = F.col("r") + 1.0, F.length("r_name").cast("double"), F.col("c").cast("double"), F.col("d").cast("double")
    triangle = lambda k, *corners: F.struct((2 * F.col("r") + k).alias("id"), *[v.alias(f"{n}{i}") for i, corner in enumerate(corners, 1) for n, v in zip("xyv", corner, strict=True)])
    both = F.array(triangle(0, (west, zero, a), (west + 2, zero, b), (west, two, c)), triangle(1, (west + 2, two, d), (west + 2, zero, b), (west, two, c)))
    return mesh.rasterised(r.select(F.explode(both).alias("t")).select("t.*"), (0.0, 10.0, 0.0, 2.0), 101, 21).select("lon", "lat", "value")


# --- clusters on principal components --------------------------------------------------------------------------------------------------


def _principal(t: _Tables) -> cluster.Components:
    return cluster.principal(t.embeddings, 2, "vec_id", "embedding")


@_query()
def pca_loadings(t):
    c = _principal(t)
    return c.loadings.crossJoin(F.broadcast(c.shares.groupBy().pivot("pc", ["pc1", "pc2"]).agg(F.first("share")).select(F.col("pc1").alias("share1"), F.col("pc2").alias("share2"))))


@_query()
def pca_top_loadings(t):
    return cluster.top_loadings(_principal(t).loadings)


@_query()
def pca_clusters(t):
    scores = _principal(t).scores.select("entity", F.col("entity").alias("ord"), F.col("pc1").alias("x"), F.col("pc2").alias("y"))
    return cluster.clustered(scores, 4)


@_query()
def cluster_legend(t):
    scores = _principal(t).scores
    found = cluster.clustered(scores.select("entity", F.col("entity").alias("ord"), F.col("pc1").alias("x"), F.col("pc2").alias("y")), 4)
    return cluster.legend(found.join(scores.select("entity", F.col("pc2").alias("lat")), "entity"))
