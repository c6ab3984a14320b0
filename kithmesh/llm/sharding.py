"""Sharding by a hierarchical weighted hash tree (op 5).

A topology is a list of leaves (region, rack, shard, weight). A key descends three levels. At each level
every child draws -ln(u) / weight, u being a hash of (key, child), and the smallest draw wins, so a
child gets keys in proportion to its weight. A changed weight moves keys only into or out of the subtrees
whose weights changed: draws of the other children don't change, and neither do draws below them.

`fleet(n)` is the topology of n shards: the first `base` shards in regions of `racks` x `shards_per_rack`, and
each further shard a region of its own, so that one more shard takes keys only into itself, whatever n is.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, gapless_rank, staged, text_of, unit_draw


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def fleet(n: int, base: int = 40, racks: int = 2, shards_per_rack: int = 5) -> list[Leaf]:
    """n shards of weight 1: up to `base` in full regions, the others in regions of one shard."""
    if n < 1:
        raise ValueError("a fleet has at least one shard")
    out = []
    for s in range(n):
        if s < base:
            region, place = divmod(s, racks * shards_per_rack)
            out.append(Leaf(f"region{region}", f"rack{place // shards_per_rack}", s))
        else:
            out.append(Leaf(f"single{s}", "rack0", s))
    return out


def _winner(key: Column, path: Column, children: Column) -> Column:
    """The child with the smallest weighted draw; ties go to the first by name. children: array of (name, weight)."""
    draws = F.transform(children, lambda c: F.struct((-F.log(unit_draw(key, path, c["name"])) / c["weight"]).alias("d"), c["name"].alias("name")))
    return F.array_min(draws)["name"]


def _children(of: Column, table: dict[str, dict[str, float]]) -> Column:
    """The children of the node that `of` names, as a literal array of (name, weight) with weights over 0."""
    out = None
    for node, weights in table.items():
        some = [F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(weights.items()) if w > 0]
        if some:
            out = (F if out is None else out).when(of == node, F.array(*some))
    if out is None:
        raise ValueError("no leaf has weight")
    return out


def shard_of(df: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """Adds `out`, the shard of each row's key. A null key is the empty text. Weights must not be negative;
    leaves of weight 0 get nothing."""
    regions: dict = defaultdict(dict)
    racks: dict = defaultdict(dict)
    for leaf in leaves:
        if leaf.weight < 0:
            raise ValueError("weights must not be negative")
        rack = f"{leaf.region}/{leaf.rack}"
        racks[rack][str(leaf.shard)] = leaf.weight
    for rack, shards in racks.items():
        region, name = rack.split("/")
        regions[region][name] = sum(shards.values())
    root = {"": {r: sum(w.values()) for r, w in regions.items()}}
    text = F.coalesce(key.cast("string"), F.lit(""))
    region, rack = fresh(df, "region"), fresh(df, "rack")
    df = df.withColumn(region, _winner(text, F.lit(""), _children(F.lit(""), root)))
    df = df.withColumn(rack, F.concat(region, F.lit("/"), _winner(text, F.col(region), _children(F.col(region), regions))))
    df = df.withColumn(out, _winner(text, F.col(rack), _children(F.col(rack), racks)).cast("int"))
    return df.drop(region, rack)


def place(docs: DataFrame, n_shards: int = 40, grown: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text plus 16), text_crc32, law `key`, shard, slot
    (from 0 without gaps in each shard) and grown_shard, its shard in a fleet of `grown` (one more) shards.

    Null texts count 0 bytes, null ids hash as the empty text, repeated rows get a slot each, an empty table
    gives an empty result, and other columns of the table are not read.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = shard_of(rows, F.col("doc_id"), fleet(n_shards), "shard")
    rows = shard_of(rows, F.col("doc_id"), fleet(grown or n_shards + 1), "grown_shard")
    rows = staged(rows, "placed")  # texts are hashed and keys placed once; the numbers below need the rows twice
    bucket = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    rows = gapless_rank(rows, ["shard"], bucket, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
