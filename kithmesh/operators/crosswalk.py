"""Matching of symbols between two inventories by levels of likeness, and the comparison of their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithmesh.functions import text as tx

#: How two symbols can match, the surest first.
LEVELS = ("exact", "composed", "letters and marks")


def keys(symbol: str) -> list[Column]:
    """A key for each of LEVELS: the symbol itself; its composed form without tie bars; its letters without marks, and its sorted marks."""
    apart = tx.nfd(F.col(symbol))
    return [F.col(symbol), tx.nfc(F.col(symbol)), F.concat(tx.base_symbol(apart), F.lit("|"), tx.modifiers(apart))]


def first_match(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], prefer: list[Column], out: str = "match", level: str = "level") -> DataFrame:
    """`left` with `out`, a struct of the row of `right` that it matches, and `level` (from 1), the first place of the two lists of keys at which one does; both null where none does.

    All levels are one join: every row brings its keys with their level, each key of `right` keeps one row, the first by `prefer` (then by the
    row itself), and a row of `left` takes its lowest level. So a row of `right` can serve many of `left`. Null keys match nothing. Repeated rows of `left` stay."""
    if len(left_keys) != len(right_keys):
        raise ValueError("both sides have a key for each level")
    listed = lambda ks: F.filter(F.array(*[F.struct(F.lit(k).alias("level"), c.cast("string").alias("key")) for k, c in enumerate(ks, 1)]), lambda x: x["key"].isNotNull())
    theirs = right.select(F.struct(*right.columns).alias("row"), F.struct(*[c.alias(f"p{k}") for k, c in enumerate(prefer)], F.struct(*right.columns).alias("r")).alias("order"), F.explode(listed(right_keys)).alias("k"))
    theirs = theirs.groupBy("k").agg(F.min_by("row", "order").alias("row"))
    mine = left.select(F.struct(*left.columns).alias("mine"), listed(left_keys).alias("ks"))
    asked = mine.select("ks").distinct().select("ks", F.explode("ks").alias("k"))
    best = asked.join(theirs, "k").groupBy("ks").agg(F.min_by(F.struct(F.col("k.level").alias("level"), "row"), F.col("k.level")).alias("b"))
    return mine.join(best, "ks", "left").select("mine.*", F.col("b.row").alias(out), F.col("b.level").alias(level))


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """symbol, class, modification, ours_idf, theirs_idf, shift, direction, in_ours, in_theirs, level: two inventories' weights side by side.

    ours: symbol, class (consonant, vowel, click, or mod_consonant and mod_vowel for rows that stand for a modification of many symbols), idf. theirs: symbol, n, idf (null
    where n is 0). Plain symbols of ours are transliterated and matched with theirs by LEVELS, of several candidates that with the largest n. Symbols of theirs that occur
    and that none of ours took follow with a class of their own, from their first letter and their marks. Weights are scaled by their smallest and largest value on each side. The
    shift is ours less theirs where both are known; for a modified symbol of theirs, the mean weight of our modification rows of that kind less its own. The direction is +, - or 0."""
    scaled = lambda df: df.agg(F.min("idf").alias("low"), F.max("idf").alias("high"))
    scale = lambda c, s: (F.col(c) - F.col(f"{s}.low")) / F.nullif(F.col(f"{s}.high") - F.col(f"{s}.low"), F.lit(0.0))
    bounds = scaled(ours).select(F.struct("low", "high").alias("o")).crossJoin(scaled(theirs.where("n > 0")).select(F.struct("low", "high").alias("t")))
    whole = F.col("class").isin("mod_consonant", "mod_vowel")
    kind = F.when(F.col("class").isin("mod_vowel", "vowel"), "v").otherwise("c")
    means = ours.where(whole).select(kind.alias("kind"), tx.modification(tx.nfd("symbol")).alias("modification"), "idf").where("modification is not null").groupBy("kind", "modification").agg(F.avg("idf").alias("mean"))

    plain = ours.where(~whole).withColumn("written", tx.transliterated(tx.nfc("symbol")))
    matched = first_match(plain, theirs, keys("written"), keys("symbol"), [-F.col("n")])
    mine = matched.select("symbol", "class", tx.modification(tx.nfd("symbol")).alias("modification"), F.col("idf").alias("o_idf"), F.when(F.col("match.n") > 0, F.col("match.idf")).alias("t_idf"), F.lit(True).alias("in_ours"), F.col("match").isNotNull().alias("in_theirs"), "level", F.lit(None).cast("double").alias("mean"))
    taken = matched.where("match is not null").select(F.col("match.symbol").alias("symbol")).distinct()
    rest = theirs.where("n > 0").join(taken, "symbol", "left_anti").withColumn("modification", tx.modification(tx.nfd("symbol"))).withColumn("vowel", tx.is_vowel(tx.nfd("symbol")))
    named = F.concat(F.when(F.col("modification").isNotNull(), "mod_").otherwise(""), F.when(F.col("vowel"), "vowel").otherwise("consonant"))
    rest = rest.withColumn("class", named).withColumn("kind", kind).join(means, ["kind", "modification"], "left")
    rest = rest.select("symbol", "class", "modification", F.lit(None).cast("double").alias("o_idf"), F.col("idf").alias("t_idf"), F.lit(False).alias("in_ours"), F.lit(True).alias("in_theirs"), F.lit(None).cast("int").alias("level"), "mean")
    both = mine.unionByName(rest).crossJoin(F.broadcast(bounds))
    both = both.withColumn("ours_idf", scale("o_idf", "o")).withColumn("theirs_idf", scale("t_idf", "t"))
    shift = F.coalesce(F.col("ours_idf"), scale("mean", "o")) - F.col("theirs_idf")
    direction = F.when(shift > 0, "+").when(shift < 0, "-").when(shift == 0, "0")
    return both.select("symbol", "class", "modification", "ours_idf", "theirs_idf", shift.alias("shift"), direction.alias("direction"), "in_ours", "in_theirs", F.col("level").cast("long").alias("level"))
