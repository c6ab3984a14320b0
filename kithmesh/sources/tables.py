"""Readers and writers: delimited text with a preamble, named matrices, trees, polygons, run metadata, cached sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithmesh.operators.staging import fresh
from kithmesh.operators.tree import parse_nexus, tree_frame


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", null: str = "NA") -> DataFrame:
    """A delimited file with a header; `null` marks missing values, an unnamed index column is dropped."""
    r = spark.read.option("header", True).option("sep", sep).option("nullValue", null)
    return (r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)).drop("_c0", "...1")


def read_after_preamble(spark: SparkSession, path: str, header_prefix: str | None = None, skip: int = 0, names: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """Delimited text of one file whose header is the first line that begins with `header_prefix`, or whose first `skip` lines
    are a preamble and whose columns are `names`. All columns are strings; empty fields are null."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))  # lines of a file keep their order
    if header_prefix is not None:
        head = lines.where(F.col("value").startswith(header_prefix)).orderBy("n").select("value", "n").first()
        if head is None:
            raise ValueError(f"no line of {path} begins with {header_prefix!r}")
        names, after = head["value"].split(sep), head["n"]
        body = lines.where(F.col("n") > after)
    else:
        starts = [r["n"] for r in lines.orderBy("n").limit(skip + 1).select("n").collect()]
        body = lines.where(F.col("n") >= starts[skip]) if len(starts) > skip else lines.limit(0)
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    return body.where("value <> ''").select(*[F.nullif(F.get(parts, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(names or [])])


def read_records(spark: SparkSession, path: str, schema: str, skip: int = 0, sep: str = "\t", null: str = "NA", zero: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Delimited text without a header, its columns given by place, name and type in `schema`, after a preamble of `skip` lines in each file.

    Fields that are `null`, empty or not of their type are null (strict: one that isn't of its type is an error); in the columns of `zero` null becomes 0. Missing fields at the end of a line are null,
    further ones are dropped, and lines without a character are left out. A file may be read in many splits: the preamble ends at a line
    that is found by the splits' places in the file, also if it runs over several of them. Quotes keep separators, not line ends."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    if skip:
        # A split's lines are numbered in their order, and splits lie one after another: the first skip + 1 lines of a file by (block, n).
        order = F.struct("block", "n")
        first = lines.select("file", "block", "n").withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("block", "n"))).where(F.col("r") <= skip)
        last = first.groupBy("file").agg(F.max(order).alias("last"), F.count(F.lit(1)).alias("seen")).where(F.col("seen") == skip)
        lines = lines.join(F.broadcast(last.select("file", "last")), "file").where(order > F.col("last"))
    options = {"sep": sep, "nullValue": null, "emptyValue": "", "mode": "FAILFAST" if strict else "PERMISSIVE"}
    rows = lines.where("value <> ''").select(F.from_csv("value", schema, options).alias("r")).select("r.*")
    return rows.na.fill(0, zero) if zero else rows


def feature_values(rows: DataFrame, wanted: list[str], entity: str = "Language_ID", feature: str = "Parameter_ID", value: str = "Value", unknown: str = "?", keep_null: bool = True) -> DataFrame:
    """entity, feature, value of an exported table of codings, for the wanted features alone (by name, in any case, given back as in the table): `unknown` and
    what isn't a number is null. keep_null: an entity that has any of the features has a row for each of them, null where it has no coding; else only known values
    stay. Of several codings of one cell the smallest known one counts."""
    names = [w.lower() for w in wanted]
    chosen = rows.where(F.lower(feature).isin(names)).select(F.col(entity).alias("entity"), F.col(feature).alias("feature"), F.expr(f"try_cast(nullif(`{value}`, '{unknown}') as int)").alias("value"))
    one = chosen.groupBy("entity", "feature").agg(F.min("value").alias("value"))
    if not keep_null:
        return one.where("value is not null")
    spelt = one.select("feature").distinct().agg(F.sort_array(F.collect_set("feature")).alias("all"))  # no more than are wanted, and their spellings
    every = one.select("entity").distinct().crossJoin(F.broadcast(spelt)).select("entity", F.explode("all").alias("feature"))
    return every.join(one, ["entity", "feature"], "left")


def bridged(rows: DataFrame, bridge: DataFrame, code: str, to: str) -> DataFrame:
    """`rows` with the column `to` that a bridge table (code, to) has for their code; null for unknown codes. A code with several targets takes the smallest, so no row is repeated."""
    one = bridge.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(to).alias(to))
    return rows.join(one, code, "left").select(*rows.columns, to)


def affiliated(rows: DataFrame, tree: DataFrame, code: str, family: str, path: str = "affiliation") -> DataFrame:
    """Rows whose code stands in an affiliation table (code, path of groups from the top, separated by commas) under `family` as its first group."""
    top = F.trim(F.get(F.split(path, ","), F.lit(0)))
    return rows.join(tree.where(top == family).select(code).distinct(), code, "left_semi")


def read_matrix(spark: SparkSession, path: str, null: str = "NA") -> DataFrame:
    """i, j, v of a matrix written with row names in its unnamed first column; names are kept as they are."""
    wide = spark.read.option("header", True).option("nullValue", null).csv(path)
    first = wide.columns[0]
    return wide.unpivot(first, wide.columns[1:], "j", "v").select(F.col(first).alias("i"), "j", F.expr("try_cast(v as double)").alias("v"))


def write_matrix(pairs: DataFrame, path: str, order: list[str]) -> None:
    """Writes i, j, v as a wide file with row names; `order` gives the columns."""
    pairs.groupBy("i").pivot("j", order).agg(F.first("v")).withColumnRenamed("i", "").write.option("header", True).mode("overwrite").csv(path)


def write_csv(df: DataFrame, path: str, null: str = "NA") -> None:
    df.write.option("header", True).option("nullValue", null).mode("overwrite").csv(path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON record."""
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """node, parent, length, label of the first tree of a NEXUS file (one file, of a size for one task)."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    return tree_frame(spark, parse_nexus(text))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """region, part, ord, lon, lat of a GeoJSON feature collection of Polygons and MultiPolygons; region is the property `name`. The rings of all of a feature's polygons are
    numbered on in `part`; the point that closes a ring by repeating its first is left out. Other geometries have no rings."""
    raw = spark.read.option("wholetext", True).text(path)
    # Coordinates have another depth in each kind, so they are read as text first.
    kind = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    f = raw.select(F.posexplode(F.from_json("value", kind)["features"]).alias("nr", "f")).select("nr", F.col("f.properties")["name"].alias("region"), "f.geometry.type", "f.geometry.coordinates")
    one, many = (F.from_json("coordinates", f"array<array<array<{x}>>>") for x in ("double", "array<double>"))
    rings = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", F.flatten(many))
    ring = f.select("nr", "region", F.posexplode(rings).alias("part", "ring"))
    open_ = F.when((F.size("ring") > 1) & (F.element_at("ring", 1) == F.element_at("ring", -1)), F.slice("ring", 1, F.greatest(F.size("ring") - 1, F.lit(1)))).otherwise(F.col("ring"))
    point = ring.select("nr", "region", "part", F.posexplode(open_).alias("ord", "p"))
    # Features that share a name are one region: parts are told apart by the feature.
    return point.select("region", (F.col("nr") * 100_000 + F.col("part")).alias("part"), "ord", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Reads `path`; where nothing is there, writes what `make` gives first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.parquet(path)
    return spark.read.parquet(path)


def exclude_box(points: DataFrame, region: DataFrame, buffer_km: float = 1000.0, km_per_degree: float = 111.32) -> DataFrame:
    """Points (lat, lon) outside the box of the region's points widened by buffer_km; null coordinates are dropped."""
    box = fresh(points, "box")
    b = region.agg(F.struct(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.avg("lat").alias("middle")).alias(box))
    at = lambda side: F.col(box)[side]
    dy, dx = F.lit(buffer_km / km_per_degree), buffer_km / (km_per_degree * F.cos(F.radians(at("middle"))))
    p = points.crossJoin(F.broadcast(b))
    inside = (F.col("lat") >= at("south") - dy) & (F.col("lat") <= at("north") + dy) & (F.col("lon") >= at("west") - dx) & (F.col("lon") <= at("east") + dx)
    return p.where(~inside).drop(box)
