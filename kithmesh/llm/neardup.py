"""Near-duplicate documents by ProbMinHash, banding and exact verification (op 2).

A document is the multiset of its five-word shingles; a shingle's weight is its number of occurrences. Likeness is
the probability Jaccard of two such vectors, sum over shared shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i). Each shingle sends arrivals of a Poisson
process with its weight as rate to random slots; a slot keeps the first arrival's shingle, and a document ends when no arrival can be
earlier than what every slot has. Slots agree with the probability of the likeness. BANDS keys of ROWS slots each put documents
into buckets; a pair of likeness 0.8 shares none with probability (1 - 0.8^4)^24 = 3e-6.

Documents with equal words are one class from the start. First each member of a bucket is compared with the bucket's hub, which takes
rows in proportion to the members and joins most of what belongs together. Then all pairs of a bucket that still lie in different
components are compared, in tiles of bounded size: once by their slots, each pair in the first bucket that it shares, and the documents that have
a pair with ENOUGH agreeing slots once more by their whole shingle sets. Tiles give the documents or the links that they found, never pairs
that aren't alike, so rows grow with members and links; the comparisons within a bucket of many components grow with its square by nature.

So a link is only lost if its documents share no bucket (see above), or, unless `exact`, if fewer than ENOUGH slots agree: 3e-9 at likeness 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, small_batches, staged, text_of

WORDS, SLOTS, ROWS = 5, 96, 4
BANDS = SLOTS // ROWS
_NONE = -(1 << 63)  # stands for a null id inside
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 17  # characters whose shingles a worker holds at once
ENOUGH = 52  # agreeing slots of a pair that is compared
LIVE = 20_000  # nodes of a file of the tables between passes
TILE_NODES, TILE_SHINGLES = 2048, 1 << 20  # a tile has two blocks of at most so many nodes, or shingles and one document more
HUB_NODES = 4096  # members of a hub that one task takes, on average


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    out = []
    for base in (_P, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_UP, _DOWN = _powers(2048)
_IS_WORD = np.array([chr(b).isalnum() or b == 95 or b > 127 for b in range(256)])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in lower case, and how many each text has. A word is a run of ASCII
    letters, digits, underscores and any non-ASCII characters; of a run over 2,000 bytes each 2,000 are a word."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    word = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start) and int((end - start).max()) > 2000:
        pieces = -(-(end - start) // 2000)
        first = np.repeat(start, pieces)
        k = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = np.repeat(end, pieces)
        start = first + 2000 * k
        end = np.minimum(start + 2000, last)
    length = end - start
    # Place of each byte in its word, and the word's sum of byte * P^place.
    values = buf[word].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(length) - length
    place = np.arange(len(values)) - np.repeat(first, length)
    out = np.add.reduceat(values * _UP[place], first) if len(first) else np.empty(0, np.uint64)
    out = _mix(out + length.astype(np.uint64))
    bounds = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))
    return out, counts


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, occurrences) of each distinct shingle. A text of one to four words has one shingle."""
    n = len(words)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        inside = np.arange(n) + j < ends
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: max(n - j, 0)] = words[j:]
        total += np.where(inside, shifted * _UP[j + 1], 0).astype(np.uint64)
    at = np.arange(n)
    first = ends - np.repeat(counts, counts)
    keep = (at + WORDS <= ends) | (at == first)
    h, d = _mix(total[keep]), doc[keep]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if not len(h):
        return d, h, np.empty(0, np.float64)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    where = np.flatnonzero(new)
    return d[where], h[where], np.diff(np.concatenate([where, [len(h)]])).astype(np.float64)


def signatures(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """n x SLOTS shingle hashes; rows of documents without shingles are 0."""
    q, sig = np.full(n * SLOTS, np.inf), np.zeros(n * SLOTS, dtype=np.uint64)
    top = np.full(n, np.inf)
    x, step = np.zeros(len(h)), 0
    while len(h):
        s = _mix(h + np.uint64((step + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        x = x - np.log1p(-(s >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
        live = x < top[doc]
        doc, h, w, x, s = doc[live], h[live], w[live], x[live], s[live]
        slot = doc * SLOTS + (_mix(s) % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(q, slot, x)
        won = x == q[slot]
        sig[slot[won]] = h[won]
        top = q.reshape(n, SLOTS).max(axis=1)
        step += 1
    return sig.reshape(n, SLOTS)


def likeness(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets, given by sorted hashes and weights."""
    if not len(ha) or not len(hb):
        return 0.0
    ia = np.flatnonzero(np.isin(ha, hb, assume_unique=True))
    ib = np.searchsorted(hb, ha[ia])
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[ib]
    if (wa == wa[0]).all() and (wb == wb[0]).all():
        return len(ia) / (len(ha) + len(hb) - len(ia))  # every ratio is 1: the plain Jaccard
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    r, xs, ys = ratio[order], x[order], y[order]
    # sum_j max(x_j / x_i, y_j / y_i): where y_j / x_j > y_i / x_i the second is larger.
    after_y = ys.sum() - np.cumsum(ys)
    upto_x = np.cumsum(xs)
    last = np.searchsorted(r, r, side="right") - 1
    total = (upto_x[last] + only_a) / xs + (after_y[last] + only_b) / ys
    return float((1 / total).sum())


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of (start, texts) of about _BLOCK bytes each; only one run is turned into strings at a time."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.empty(0, np.int64)
    start = 0
    while start < len(texts):
        done = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + _BLOCK, side="right")))
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def _nodes(texts: list[str], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each text's words (or of the text, where it has none): the identity of texts with equal
    words. Among 10^10 different texts fewer than three pairs are expected to share one."""
    out, end = [], 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        end += n
        of = words[end - n : end].tobytes() if n else b"\1" + text.encode("utf-8", "surrogatepass")
        out.append(hashlib.blake2b(of, digest_size=8).digest())
    return np.frombuffer(b"".join(out), np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, the text's node and hash, and 32 bits of each slot (none for a text without words)."""
    for batch in batches:
        ids, hashes, texts = batch.column("id"), batch.column("h"), batch.column("text")
        for at, some in _blocks(texts):
            words, counts = word_hashes(some)
            sig = signatures(*shingles(words, counts), len(some)).astype(np.uint32).view(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, SLOTS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[counts > 0].ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), pa.array(_nodes(some, words, counts)), hashes.slice(at, len(some)), lists], names=["id", "node", "h", "slots"])


def _band_keys() -> Column:
    """An array with a key for each band."""
    slot = lambda b, k: F.element_at("slots", (b * ROWS + k + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[slot(b, k) for k in range(ROWS)]))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id")
        for at, some in _blocks(batch.column("text")):
            words, counts = word_hashes(some)
            doc, h, w = shingles(words, counts)
            # Sorted by hash within a document; the order of uint64 is kept by the reader.
            offsets = np.searchsorted(doc, np.arange(len(some) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(some)), pa.array(_nodes(some, words, counts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.astype(np.int32)))],
                names=["id", "node", "h", "w"],
            )


def _split(col: pa.Array, kind: type) -> list[np.ndarray]:
    at = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _against_hub(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a: hub, b) of rows (hub, node, h, w) that follow their hub's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            a, b = [], []
            rows = zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), _split(batch.column("h"), np.int64), _split(batch.column("w"), np.float64), strict=True)
            for hub, node, h, w in rows:
                if node == hub:
                    own = h.view(np.uint64), w
                elif likeness(*own, h.view(np.uint64), w) >= threshold:
                    a.append(hub)
                    b.append(node)
            # The hub's row may lie in an earlier batch, whose memory isn't ours.
            own = own and (own[0].copy(), own[1].copy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _hub_links(pairs: DataFrame, sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """The pairs (hub, node) that are alike, as (a, b). A hub's members are dealt over as many tasks as HUB_NODES needs, each with the hub's set."""
    many = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(many, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / HUB_NODES)).alias("deal"))
    rows = dealt.unionByName(dealt.select("hub", F.col("hub").alias("node"), "deal").distinct())
    rows = rows.join(sets.select(F.col("id").alias("node"), "h", "w"), "node").repartition("hub", "deal").sortWithinPartitions("hub", "deal", F.col("node") != F.col("hub"))
    with small_batches(pairs.sparkSession):
        return staged(rows.select("hub", "node", "h", "w").mapInArrow(_against_hub(threshold), "a long, b long").coalesce(parts), "links")


def _tiles(rows: DataFrame, cost: Column, limit: int) -> DataFrame:
    """rows (key, node, label, ...) with x, y and side: each key's rows are cut into blocks of about `limit` cost in the order of their labels, and those of blocks x and y meet in tile (x, y), on sides 0
    and 1; on side 0 alone where x = y. Tiles of one label alone are left out."""
    upto = F.sum(cost).over(Window.partitionBy("key").orderBy("label", "node").rowsBetween(Window.unboundedPreceding, 0))
    cutup = rows.withColumn("block", F.floor((upto - 1) / limit))
    blocks = cutup.groupBy("key", "block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    x, y = (blocks.select("key", F.col("block").alias(n), F.col("l0").alias(f"{n}0"), F.col("l1").alias(f"{n}1")) for n in "xy")
    meet = x.join(y, "key").where("x <= y and least(x0, y0) <> greatest(x1, y1)").select("key", "x", "y")
    sides = F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    meet = meet.select("key", "x", "y", F.explode(sides).alias("side")).withColumn("block", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")))
    return cutup.join(meet, ["key", "block"]).drop("block")


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole tiles of rows sorted by tile, with the bounds of the tiles; only the tile that a batch ends in is kept for the next one."""
    kept: list[pa.RecordBatch] = []

    def run() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(kept).combine_chunks()
        tile = np.stack([rows[c].to_numpy() for c in ("key", "x", "y")])
        new = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1
        return rows, np.concatenate([[0], new, [len(rows)]])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(batch.column(c)[k].as_py() for c in ("key", "x", "y")) for k in (0, -1)]
        kept.append(batch)
        if last in (None, ends[0]) and ends[0] == ends[1]:
            last = ends[1]
            continue
        rows, bounds = run()
        yield rows.slice(0, bounds[-2]), bounds[:-1]
        kept, last = rows.slice(bounds[-2]).to_batches(), ends[1]
    if kept:
        yield run()


def _near(enough: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, node) of those of a tile that have a pair in different components, with `enough` agreeing slots and no earlier band in common."""

    def small(slots: np.ndarray, label: np.ndarray, band: np.ndarray, row: np.ndarray, end: np.ndarray, hit: np.ndarray) -> None:
        """The pairs of each of `row` with the rows after it up to `end`, many tiles at once."""
        n = end - row - 1
        i = np.repeat(row, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
        for at in range(0, len(i), 8192):
            a, b = i[at : at + 8192], j[at : at + 8192]
            same = slots[a] == slots[b]
            met = same.reshape(-1, BANDS, ROWS).all(axis=2) & (np.arange(BANDS) < band[a][:, None])
            found = (same.sum(axis=1) >= enough) & ~met.any(axis=1)
            hit[a[found]] = hit[b[found]] = True

    def large(slots: np.ndarray, label: np.ndarray, side: np.ndarray, band: int, hit: np.ndarray) -> None:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b if len(b) else a
        right, of_right = np.ascontiguousarray(slots[b].T), label[b]
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            differ = label[some][:, None] != of_right[None, :]
            if not differ.any():
                continue
            agree, met = np.zeros(differ.shape, np.uint8), np.zeros(differ.shape, bool)
            for k in range(BANDS):
                whole = np.ones(differ.shape, bool)
                for j in range(k * ROWS, (k + 1) * ROWS):
                    same = slots[some, j][:, None] == right[j][None, :]
                    agree += same
                    whole &= same
                if k < band:
                    met |= whole
            found = differ & ~met & (agree >= enough)
            hit[some] |= found.any(axis=1)
            hit[b] |= found.any(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_tiles(batches):
            slots = rows["slots"].combine_chunks().flatten().to_numpy().reshape(-1, SLOTS)
            label, side, band = (rows[c].to_numpy() for c in ("label", "side", "band"))
            hit, n = np.zeros(len(rows), bool), np.diff(bounds)
            simple = (n <= 64) & ~np.logical_or.reduceat(side > 0, bounds[:-1])
            row = np.flatnonzero(np.repeat(simple, n))
            small(slots, label, band, row, np.repeat(bounds[1:], n)[row], hit)
            for k in np.flatnonzero(~simple):
                of = slice(bounds[k], bounds[k + 1])
                large(slots[of], label[of], side[of], int(band[bounds[k]]), hit[of])
            yield from rows.select(["key", "node"]).filter(pa.array(hit)).to_batches()

    return run


def _most_alike(x: np.ndarray, y: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bounds of the likeness of one document with others: y are the shares that shingles have of their document's weight, x the shares that they have of the one's (or 0), first and size where
    the documents lie. Of the sum over all j of max(x_j / x_i, y_j / y_i) those that only one document has add (1 - shared x) / x_i and (1 - shared y) / y_i, and the shared ones
    no less than shared x / x_i and shared y / y_i."""
    only_x = np.repeat(np.maximum(1 - np.add.reduceat(x, first), 0), size)
    only_y = np.repeat(np.maximum(1 - np.add.reduceat(np.where(x > 0, y, 0.0), first), 0), size)
    return np.add.reduceat(x * y / np.maximum(y + only_y * x, x + only_x * y), first)


def _linking(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) that join all components of a tile that have documents alike across its sides (or anywhere, if it has one side)."""

    def links(tile: pa.Table) -> pa.RecordBatch:
        node, side = tile["node"].to_numpy(), tile["side"].to_numpy()
        comp = np.unique(tile["label"].to_numpy(), return_inverse=True)[1]
        lists = tile["h"].combine_chunks()
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        words, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        w = tile["w"].combine_chunks().flatten().to_numpy().astype(np.float64)
        mass = w / np.repeat(np.add.reduceat(w, first), size)
        even = np.minimum.reduceat(w, first) == np.maximum.reduceat(w, first)
        h, mark = lists.flatten().to_numpy().view(np.uint64), np.zeros(len(words))
        rows, one_side, a, b = np.arange(len(node)), not side.any(), [], []
        odd = np.repeat(~even, size)
        uneven = rows[~even], place[odd], np.cumsum(size[~even]) - size[~even]
        uneven_mass = mass[odd]
        most = comp == np.bincount(comp).argmax()
        for x in np.flatnonzero(~most):  # pairs within the largest component aren't needed, others are met from their rows outside it
            ok = (comp != comp[x]) & (most | (rows > x)) & (one_side | (side != side[x]))
            if not ok.any():
                continue
            mine = slice(first[x], first[x] + size[x])
            alike = np.zeros(len(node), bool)
            plain = ok & even if even[x] else alike
            if plain.any():
                mark[place[mine]] = 1
                shared = np.add.reduceat(mark[place], first)
                alike = plain & (shared / (size[x] + size - shared) >= threshold)
            rest = ok & ~plain
            if rest.any():
                mark[place[mine]] = mass[mine]
                among, at, bounds = uneven if even[x] else (rows, place, first)
                bound = np.zeros(len(node))
                bound[among] = _most_alike(mark[at], uneven_mass if even[x] else mass, bounds, size[among])
                for y in np.flatnonzero(rest & (bound >= threshold - 1e-9)):
                    its = slice(first[y], first[y] + size[y])
                    alike[y] = comp[y] != comp[x] and likeness(h[mine], w[mine], h[its], w[its]) >= threshold
            mark[place[mine]] = 0
            for y in np.flatnonzero(alike):
                if comp[y] != comp[x]:
                    a.append(node[x])
                    b.append(node[y])
                    comp[comp == comp[y]] = comp[x]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_tiles(batches):
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                yield links(rows.slice(start, end - start))

    return run


def _tile_links(members: DataFrame, labels: DataFrame, live: DataFrame, sets: DataFrame, threshold: float, enough: int, parts: int) -> DataFrame:
    """Links (a, b) that join all components with documents that are alike, share a bucket of `members` (node, band, key) and agree in `enough` slots."""
    now = members.select("node", "band", "key").join(labels.withColumnRenamed("id", "node"), "node")
    mixed = now.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
    now = staged(now.join(mixed, "key", "left_semi").coalesce(8 * parts), "mixed")
    tile = ["key", "x", "y"]
    with small_batches(members.sparkSession):
        tiles = _tiles(now, F.lit(1), TILE_NODES).join(live.select("node", "slots"), "node")
        near = tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_near(enough), "key long, node long")
        near = staged(near.distinct().coalesce(8 * parts), "near")
        light = near.join(now, ["key", "node"]).join(sets.select(F.col("id").alias("node"), "n"), "node")
        tiles = _tiles(light, F.greatest("n", F.lit(TILE_SHINGLES // TILE_NODES)), TILE_SHINGLES).join(sets.select(F.col("id").alias("node"), "h", "w"), "node")
        links = staged(tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_linking(threshold), "a long, b long").coalesce(parts), "links")
    discard(now, near)
    return links


def merged(labels: DataFrame, edges: DataFrame, parts: int = 16) -> DataFrame:
    """labels (id, label; staged, and deleted here once there are newer ones) after all edges (a, b) between ids of labels have joined what
    they touch; a label is the smallest id of its component. Each pass hooks every label to the smallest neighbouring one and jumps once. Tables in between have at most `parts` files."""
    edges = staged(edges.select("a", "b").coalesce(parts), "edges")
    while True:
        la = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        lb = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        apart = staged(edges.join(la, "a").join(lb, "b").where("la <> lb").select("a", "b", F.greatest("la", "lb").alias("c"), F.least("la", "lb").alias("p")).coalesce(parts), "apart")
        discard(edges)
        hooks = apart.groupBy("c").agg(F.min("p").alias("p"))
        further = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        hooks = staged(hooks.join(further, "p", "left").select("c", F.coalesce("pp", "p").alias("p")).coalesce(parts), "hooks")
        if hooks.isEmpty():
            discard(apart, hooks)
            return labels
        edges, old = apart, labels
        labels = staged(labels.join(hooks, labels["label"] == hooks["c"], "left").select("id", F.coalesce("p", "label").alias("label")).coalesce(parts), "labels")
        discard(hooks, old)


def classes(docs: DataFrame, threshold: float = 0.8, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row.

    Classes are the connected components of likeness >= `threshold` between texts; equal word sequences are alike. Null texts are
    empty. A text without any word is only alike to equal texts; all empty ones are one class. Repeated rows are one row each, of one class. Null ids are kept, and
    are smaller than all others. An empty table gives an empty result; other columns aren't read. `exact`: pairs of a bucket are compared whatever their slots.
    """
    sketch, known = _joined(docs, threshold, exact, id_col, text_col)
    # A class is named by the smallest id of its documents.
    names = known.groupBy("label").agg(F.min("id").alias("class"))
    named = known.join(names, "label").select("node", "class")
    out = sketch.select("id", "node").join(named, "node")
    back = lambda c: F.when(F.col(c) != F.lit(_NONE), F.col(c))
    return out.select(back("id").alias("doc_id"), back("class").alias("class_id"))


def _key(col: str) -> Column:
    """An id as it is inside."""
    return F.coalesce(F.col(col).cast("long"), F.lit(_NONE))


def _joined(docs: DataFrame, threshold: float, exact: bool, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, node, h: hash of the text) and the nodes (node, its smallest id, label: one for each class)."""
    text = text_of(text_col)
    rows = docs.select(_key(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    with small_batches(docs.sparkSession):
        sketch = staged(rows.mapInArrow(_sketched, "id long, node long, h long, slots array<int>"), "sketches")
    wide = staged(sketch.groupBy("node").agg(F.min("id").alias("id"), F.first("slots").alias("slots")), "wide")
    sketch, old = staged(sketch.select("id", "node", "h"), "rows"), sketch
    discard(old)
    bucketed = staged(wide.where(F.size("slots") > 0).select("node", F.posexplode(_band_keys()).alias("band", "key")).withColumn("band", F.col("band").cast("byte")), "bucketed")
    hubs = bucketed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(bucketed.join(hubs.select("key", "hub"), "key"), "members")
    discard(bucketed)
    live = staged(wide.join(members.select("node").distinct(), "node"), "live")
    nodes = staged(wide.select("node", "id"), "nodes")
    discard(wide)
    parts = max(16, live.count() // LIVE)  # files of the tables between passes: in proportion to the nodes
    made = rows.drop("h").join(live.select("id").distinct(), "id", "left_semi")
    with small_batches(docs.sparkSession):
        sets = made.mapInArrow(_sets, "id long, node long, h array<long>, w array<int>").join(live.select("id", "node"), ["id", "node"], "left_semi")
        sets = staged(sets.groupBy("node").agg(F.first("h").alias("h"), F.first("w").alias("w")).select(F.col("node").alias("id"), "h", "w", F.size("h").alias("n")), "sets")
    labels = staged(live.select(F.col("node").alias("id"), F.col("node").alias("label")).coalesce(parts), "labels")
    pairs = _worth(members.where("node <> hub").select("hub", "node").distinct(), live, parts)
    links = _hub_links(pairs, sets, threshold, parts)
    discard(pairs)
    labels = merged(labels, links, parts)
    links, old = _tile_links(members, labels, live, sets, threshold, 0 if exact else ENOUGH, parts), links
    discard(old, members, live, sets)
    labels, old = merged(labels, links, parts), links
    discard(old)
    return sketch, nodes.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))


def _worth(pairs: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """The pairs (hub, node) of which at least ENOUGH slots agree."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("slots").alias(f"s_{x}")) for x in ("hub", "node"))
    agree = F.aggregate(F.zip_with("s_hub", "s_node", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return staged(pairs.join(a, "hub").join(b, "node").where(agree >= ENOUGH).select("hub", "node").coalesce(parts), "pairs")


def dedup(docs: DataFrame, threshold: float = 0.8, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that with the smallest id (null first), and of those the one whose text hashes
    lowest. Classes whose smallest ids are equal or null keep a row each; of rows with one id and text any is kept. An empty table
    gives an empty result."""
    sketch, known = _joined(docs, threshold, exact, id_col, text_col)
    rows = sketch.select("id", "node", "h").join(known.select("node", "label"), "node").groupBy("label", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    kept = staged(rows.groupBy("label").agg(F.min(F.struct("id", "h", "n")).alias("k")).select("k.*"), "kept")
    i, h = fresh(docs, "id"), fresh(docs, "hash")
    keyed = docs.withColumn(i, _key(id_col)).withColumn(h, F.xxhash64(text_of(text_col)))
    out = keyed.join(kept.select(F.col("id").alias(i), F.col("h").alias(h)), [i, h], "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates([i, h])
    return out.drop(i, h)
