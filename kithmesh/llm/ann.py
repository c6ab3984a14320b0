"""Approximate nearest neighbours by inner product, with balanced posting lists (op 1).

Vectors x become points (x, sqrt(M^2 - |x|^2)) on a sphere, M being the largest norm, and queries (q M/|q|, 0), so that
the largest inner product is the smallest distance. A bounded sample is halved again and again at the median between two means: the leaves,
equal in size, give the centroids. Centroids form a graph that every worker holds in memory and walks best-first.
A vector goes to the list of its nearest centroid and, near a boundary, to further ones whose distance is within a
ratio of the nearest. A query walks the same graph and reads its nearest lists whose distance is within a ratio of the nearest one's. The ratio and the
number of lists are those that hold the wanted share of the exact answers of a sample of queries, so what is read grows with the table. Lists that grow beyond `list_rows` are dealt over several tasks. A query first reads a few of its lists: its k-th best score there
is a floor, and the search of all its lists gives no vector below it, and each vector once, in the first list that both have. So a query's rows don't grow with the lists
that it reads. Equal vectors are searched once; each stands for its smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass
class Graph:
    """Centroids, and for each the places of its neighbours (and itself where there are fewer)."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def nearest(self, x: np.ndarray, want: int, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of about the `want` nearest centroids of each row of x, nearest first; best-first
        search over the graph, for all rows at once."""
        n, k = len(x), len(self.points)
        beam = min(max(beam, want + 16), k)
        norms = (self.points**2).sum(axis=1)
        own = (x**2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        start = self.entries[:beam]
        seen[:, start] = True
        dist = norms[start] - 2 * x @ self.points[start].T
        place = np.broadcast_to(start, dist.shape).copy()
        done = np.zeros_like(place, dtype=bool)
        rows = np.arange(n)
        while True:
            open_ = np.where(done, np.inf, dist)
            best = open_.argmin(axis=1)
            live = np.isfinite(open_[rows, best])
            if not live.any():
                break
            r = rows[live]
            done[r, best[live]] = True
            near = self.links[place[r, best[live]]]
            fresh = ~seen[r[:, None], near]
            seen[r[:, None], near] = True
            d = norms[near] - 2 * np.einsum("rd,rld->rl", x[r], self.points[near])
            d[~fresh] = np.inf
            full_d = np.full((n, near.shape[1]), np.inf)
            full_p = np.zeros((n, near.shape[1]), dtype=place.dtype)
            full_d[r], full_p[r] = d, near
            dist = np.concatenate([dist, full_d], axis=1)
            place = np.concatenate([place, full_p], axis=1)
            done = np.concatenate([done, np.zeros(full_d.shape, dtype=bool)], axis=1)
            if dist.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                dist, place, done = (np.take_along_axis(a, keep, axis=1) for a in (dist, place, done))
            done |= ~np.isfinite(dist)
        order = np.lexsort((place, dist), axis=1)[:, : min(want, beam)]
        return np.take_along_axis(place, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1) + own[:, None], 0))


    def ordered(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """As `nearest`, but exactly: places and distances of the `want` nearest centroids of each row of x."""
        dist = (self.points**2).sum(axis=1) - 2 * x @ self.points.T
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        return order, np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1) + (x**2).sum(axis=1)[:, None], 0))


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of the leaves of a balanced splitting of the sample."""
    rng = np.random.default_rng(seed)
    leaves, out = [sample], []
    while leaves and len(leaves) + len(out) < lists:
        leaves.sort(key=len)
        part = leaves.pop()
        if len(part) < 2:
            out.append(part)
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            side = ((part - a) ** 2).sum(axis=1) <= ((part - b) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            a, b = part[side].mean(axis=0), part[~side].mean(axis=0)
        order = np.argsort(part @ (b - a), kind="stable")
        half = len(part) // 2
        leaves += [part[order[:half]], part[order[half:]]]
    return np.array([p.mean(axis=0) for p in (*leaves, *out)])


def graph(points: np.ndarray, degree: int = 16) -> Graph:
    """Each centroid is linked to near ones that none of its links is closer to, and they to it; one ring through all
    of them keeps the graph connected."""
    k = len(points)
    norms = (points**2).sum(axis=1)
    links: list[list[int]] = []
    for i in range(k):
        d = norms - 2 * points @ points[i]
        near = np.argsort(d, kind="stable")[: 4 * degree + 1]
        kept: list[int] = []
        for j in near[near != i].tolist():
            to_kept = ((points[kept] - points[j]) ** 2).sum(axis=1) if kept else np.array([np.inf])
            if to_kept.min() > d[j] + norms[i] and len(kept) < degree:
                kept.append(j)
        kept += [j for j in near[near != i].tolist() if j not in kept][: degree - len(kept)]
        links.append(kept)
    both: list[set[int]] = [set(x) for x in links]
    for i, x in enumerate(links):
        both[i].add((i + 1) % k)
        for j in x[: degree // 2]:
            both[j].add(i)
    width = max(map(len, both))
    table = np.array([sorted(x) + [i] * (width - len(x)) for i, x in enumerate(both)], dtype=np.int64)
    return Graph(points, table, np.linspace(0, k - 1, min(k, 16)).astype(np.int64))


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def aimed(q: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([q * (most / np.sqrt((q**2).sum(axis=1)))[:, None], np.zeros((len(q), 1))], axis=1)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def _within(dist: np.ndarray, ratio: float, most: float) -> np.ndarray:
    """Which of the lists at these distances, nearest first, lie within the ratio of the nearest; that one's distance
    counts as at least a twentieth of the sphere's radius."""
    return dist <= ratio * np.maximum(dist[:, :1], most / 20) + 1e-12


def _rows_of(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """A list for each of n rows: the values at its places in `row`, which ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _listed(
    batches: Iterator[pa.RecordBatch], g: Graph, most: float, dim: int, queries: bool, lists: int, ratio: float, beam: int, parts: np.ndarray | None, units: int | None = None
) -> Iterator[pa.RecordBatch]:
    """(list, part, rep, vector, among: all its lists) of each vector or query, for every list that it belongs to or reads; of queries also the floor.
    parts: tasks of each list; units: how many tasks of its nearest lists a query reads at most."""
    block = max(64, min(4096, (1 << (23 if queries else 25)) // len(g.points)))
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            some = batch.slice(at, block)
            x = _matrix(some.column("vector"), dim)
            point = aimed(x, most) if queries else lifted(x, most)
            place, dist = g.nearest(point, lists, beam)
            take = _within(dist, ratio, most) if queries else dist <= ratio * dist[:, :1] + 1e-12
            if units:
                take[:, units:] = False
            row, col = np.nonzero(take)
            chosen = place[row, col]
            among = _rows_of(row, chosen, some.num_rows)
            if queries and parts is not None:
                n = parts[chosen]
                row, chosen = np.repeat(row, n), np.repeat(chosen, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            else:
                part = np.zeros(len(row), dtype=np.int64)
            if units:
                near = np.arange(len(row)) - np.searchsorted(row, row) < units
                row, chosen, part = row[near], chosen[near], part[near]
            own = [some.column(c).take(pa.array(row)) for c in ("rep", "vector")]
            floor = [some.column("floor").take(pa.array(row))] if queries else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen.astype(np.int32)), pa.array(part.astype(np.int32)), *own, among.take(pa.array(row)), *floor],
                names=["list", "part", "rep", "vector", "among", *(["floor"] if queries else [])],
            )


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and how many each row has."""
    col = table.column(column).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _found(members: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best members of one part of a list for each query that reads it: those not below the query's floor, and not in an earlier list
    (of a smaller number) that the query reads too. Ties go to the smaller rep."""
    out = []
    if members.num_rows and queries.num_rows:
        here = members.column("list")[0].as_py()
        members = members.sort_by("rep")
        reps, n = members.column("rep").to_numpy(), members.num_rows
        m = _flat(members, "vector")[0].reshape(n, -1)
        lists, size = _flat(members, "among")
        other = np.full((n, int(size.max())), here, dtype=np.int64)
        other[np.arange(other.shape[1]) < size[:, None]] = lists
        largest = np.sqrt((m**2).sum(axis=1).max())
        for at in range(0, queries.num_rows, 512):
            some = queries.slice(at, 512)
            q = _flat(some, "vector")[0].reshape(some.num_rows, -1)
            read, size = _flat(some, "among")
            reads = np.zeros((len(q), here + 1), dtype=bool)  # of the lists before this one
            who = np.repeat(np.arange(len(q)), size)[read < here]
            reads[who, read[read < here]] = True
            floor = some.column("floor").combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            floor = floor - 1e-12 * largest * np.sqrt((q**2).sum(axis=1))  # the last bits of a product depend on the block
            scores = q @ m.T
            row, col = np.nonzero(scores >= floor[:, None])
            fresh = ~reads[row[:, None], np.minimum(other[col], here)].any(axis=1)
            row, col = row[fresh], col[fresh]
            score = scores[row, col]
            order = np.lexsort((col, -score, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]  # `row` ascends, also in this order
            out.append(pa.table({"query": some.column("rep").to_numpy()[row[order]], "rep": reps[col[order]], "score": score[order]}))
    return pa.concat_tables(out) if out else pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _scanned(batches: Iterator[pa.RecordBatch], asked: np.ndarray, reps: np.ndarray, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best vectors of these batches for each asked one, by its place, without the one itself."""
    score, rep = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            own = some.column("rep").to_numpy()
            s = asked @ _matrix(some.column("vector"), dim).T
            s[reps[:, None] == own] = -np.inf
            score, rep = np.concatenate([score, s], axis=1), np.concatenate([rep, np.broadcast_to(own, s.shape)], axis=1)
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, rep = np.take_along_axis(score, top, axis=1), np.take_along_axis(rep, top, axis=1)
    row, col = np.nonzero(np.isfinite(score))
    yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(rep[row, col]), pa.array(score[row, col])], names=["q", "rep", "score"])


def reach(points: DataFrame, g: Graph, most: float, dim: int, k: int, copies: int, copy_ratio: float, recall: float, sample: int) -> tuple[int, float, int]:
    """(lists, ratio, beam) of a query, from the exact k nearest of at most `sample` queries: the ratio within which lists hold the share
    (1 + recall) / 2 of them, how many lists within it hold the share `recall`, and the beam with which the graph finds 99 % of those lists.
    The exact ones come from a scan of all points."""
    asked = points.where("asks").orderBy(F.xxhash64("rep", F.lit(1)), "rep").select("rep", "vector").limit(sample).collect()
    if not asked:
        return 1, 1.0, 32
    q, reps = np.array([r["vector"] for r in asked], dtype=np.float64), np.array([r["rep"] for r in asked])
    scanned = points.select("rep", "vector").mapInArrow(partial(_scanned, asked=q, reps=reps, dim=dim, k=k), "q int, rep long, score double")
    best = scanned.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("rep")))), 1, k).alias("hit")).select("q", F.explode("hit.rep").alias("rep"))
    found = points.select("rep", "vector").join(F.broadcast(best), "rep").select("q", "vector").collect()  # at most sample * k rows
    if not found:
        return 1, 1.0, 32
    who, aim = np.array([r["q"] for r in found]), aimed(q, most)
    order, dist = g.ordered(aim, len(g.points))
    rank = np.argsort(order, axis=1)
    place, far = g.nearest(lifted(np.array([r["vector"] for r in found], dtype=np.float64), most), copies)
    at = np.where(far <= copy_ratio * far[:, :1] + 1e-12, rank[who[:, None], place], len(g.points)).min(axis=1)
    last = lambda need, share: np.sort(need)[int(np.ceil(share * len(need))) - 1]
    near = dist[who, at] / np.maximum(dist[who, 0], most / 20)
    ratio = max(1.0, float(last(near, (1 + recall) / 2)) * (1 + 1e-9))
    lists = int(last(np.where(near <= ratio, at, len(g.points)), recall)) + 1
    inside = _within(dist, ratio, most) & (np.arange(len(g.points)) < lists)
    beam = max(32, lists + 16)
    while beam < len(g.points):
        seen = np.zeros_like(inside)
        np.put_along_axis(seen, g.nearest(aim, lists, beam)[0], True, axis=1)
        if (np.take_along_axis(seen, order, axis=1) & inside).sum() >= 0.99 * inside.sum():
            break
        beam += beam // 2
    return lists, ratio, min(beam, len(g.points))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 20_000,
    list_mean: int = 50,
    most_lists: int = 4096,
    list_rows: int = 2_000,
    copies: int = 8,
    copy_ratio: float = 1.2,
    read_lists: int = 1,
    recall: float = 0.96,
    judged: int = 256,
    first_units: int = 8,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k nearest other rows that were found, by inner product,
    nearest first, ties to the smaller vec_id; all found ones if there are fewer.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id or a
    length other than the most frequent one (the larger of two as frequent). Rows that share id and vector are one
    candidate, and a query for each row. An empty table gives an empty result; other columns aren't read. `sample` bounds the vectors that the centroids are
    fitted on, `most_lists` their number; every vector is indexed, also those outside the sample. A query reads as many nearest lists, within
    the ratio, as `judged` sampled queries need to find the share `recall` of their exact answers (or `read_lists`, if that is more). Its floor comes from
    `first_units` tasks of its nearest lists; it bounds the rows that are handed on and changes no answer.
    """
    vector = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("vector") == dim)
    # Equal vectors: each salt keeps its k + 1 smallest ids, then all salts together do.
    salts = max(16, n // 100_000)
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    some = rows.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"), F.max("asks").alias("asks"))
    points = some.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("asks").alias("asks")).withColumn("rep", F.col("ids")[0])
    points = staged(points.select("rep", "ids", "asks", "vector"), "points")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(norm)).alias("most")).first()
    fit_on = points.orderBy(F.xxhash64("rep"), "rep").select("vector").limit(sample)
    x = np.array([r["vector"] for r in fit_on.toLocalIterator()], dtype=np.float64)
    lists = int(max(1, min(most_lists, facts["n"] // list_mean, len(x))))
    g = graph(centroids(lifted(x, facts["most"]), lists)) if lists > 1 else Graph(lifted(x, facts["most"]).mean(axis=0)[None, :], np.zeros((1, 1), np.int64), np.zeros(1, np.int64))
    schema = "list int, part int, rep long, vector array<double>, among array<int>"
    put = partial(_listed, g=g, most=facts["most"], dim=dim)
    members = staged(points.select("rep", "vector").mapInArrow(partial(put, queries=False, lists=copies, ratio=copy_ratio, beam=32, parts=None), schema), "postings")
    needed, read_ratio, beam = reach(points, g, facts["most"], dim, k, copies, copy_ratio, recall, judged) if lists > 1 else (1, 1.0, 32)
    read_lists = min(max(read_lists, needed), lists)
    parts = np.ones(lists, dtype=np.int64)
    for r in members.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `most_lists` rows
        parts[r["list"]] = -(-r["n"] // list_rows)
    table = F.array(*[F.lit(int(p)) for p in parts]) if lists <= 64 else None
    if int(parts.max()) > 1:
        if table is None:
            table = F.from_json(F.lit("[" + ",".join(map(str, parts.tolist())) + "]"), "array<int>")
        members = members.withColumn("part", F.pmod(F.xxhash64("rep"), F.element_at(table, F.col("list") + 1)).cast("int"))
    put = partial(put, queries=True, lists=read_lists, ratio=read_ratio, beam=beam, parts=parts)

    def hits_of(queries: DataFrame, units: int | None) -> DataFrame:
        asked = queries.select("rep", "vector", "floor").mapInArrow(partial(put, units=units), schema + ", floor double")
        hits = members.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(partial(_found, k=k + 1), "query long, rep long, score double")
        return hits.groupBy("query", "rep").agg(F.max("score").alias("score"))

    asking = points.where("asks").withColumn("floor", F.lit(None).cast("double"))
    if read_lists * int(parts.max()) > first_units:
        few = hits_of(asking, first_units).groupBy("query").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("floor"))
        asking = points.where("asks").join(few.withColumnRenamed("query", "rep"), "rep", "left")
    hits = hits_of(asking, None)
    first = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    # A query has up to k + 1 hits from each part of the lists that it reads: each salt keeps its best ones, then all salts together do.
    salts = int(max(1, read_lists * int(parts.max()) // 64))
    hits = hits.withColumn("hit", F.struct((-F.col("score")).alias("s"), F.col("rep")))
    hits = hits.groupBy("query", F.pmod(F.xxhash64("rep"), F.lit(salts)).alias("salt")).agg(first(F.collect_list("hit")).alias("hit"))
    best = hits.groupBy("query").agg(first(F.flatten(F.collect_list("hit"))).alias("hit")).select("query", F.explode("hit").alias("hit"))
    ids = best.select("query", F.col("hit.rep").alias("rep"), F.col("hit.s").alias("s")).join(points.select("rep", "ids"), "rep")
    top = ids.groupBy("query").agg(first(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("s"), i.alias("id")))))).alias("top"))
    queries = rows.where("asks").join(points.where("asks").select("vector", F.col("rep").alias("query")), "vector").select(F.col("id").alias("query_id"), "query")
    own = queries.join(top, "query").select("query_id", F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, k).alias("top"))
    out = own.select("query_id", F.posexplode("top").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def brute_force(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """Exact answers, for measuring recall on small tables: query id -> [(vec_id, score)]."""
    out = {}
    order = np.argsort(ids, kind="stable")
    v, s = vectors[order], ids[order]
    where = {int(i): p for p, i in enumerate(s)}
    for q in queries:
        scores = v @ v[where[int(q)]]
        scores[where[int(q)]] = -np.inf
        top = np.argsort(-scores, kind="stable")[:k]
        out[int(q)] = [(int(s[t]), float(scores[t])) for t in top if np.isfinite(scores[t])]
    return out
