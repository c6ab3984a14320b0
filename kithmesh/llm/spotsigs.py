"""SpotSigs document fingerprints in DataFrame functions alone (op 4).

Words are runs of letters and digits in lower case. An anchor is a common word; its signature is the anchor and the next CHAIN
content words (words that aren't common) after it. In a text without any common word, whose fingerprint would be empty, a content word
whose md5 begins with 0 or 1 (one in eight) is an anchor, and so is the start of the text. A
fingerprint is the set of signatures, each as the first 8 hex digits of its md5, in ascending order without gaps between them; likeness is
Jaccard. Different chains share 32 bits with probability 2^-32, so that a text of 10,000 chains is expected to have 0.01 such pairs.

The join of similar documents deals documents by the length of their sets: a pair can only reach a threshold t if the
smaller set has at least t times the size of the larger. It meets on the rarest signatures of each set, as many as a similar set can't all miss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

CHAIN = 2
_NONE = -(1 << 63)
#: Common words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be been but by for from had has have he her his if in into is it its not of on or our she that the their them then there these they this to was we were which with you "
    "aber auch auf aus bei das dem den der des die durch ein eine einen einer es für hat ich im ist mit nach nicht sich sie sind um und von war wie wird zu zum zur über "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas pour qui que sa se ses son sont sur un une vous "
    "al como con del donde el ella era este esta fue ha las lo los más muy no para pero por se ser si sin su sus también un una y"
).split()
COMMON = sorted(set(COMMON))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The set of a text's signatures as 8 hex digits each, ascending. No signature for a text without words."""
    marked = F.transform(words_of(text), lambda w, i: F.struct(w.alias("w"), i.alias("i"), w.isin(COMMON).alias("c")))

    def from_marked(m: Column) -> Column:
        return _let(F.filter(m, lambda x: ~x["c"]), lambda content: from_content(m, content))

    def from_content(m: Column, content: Column) -> Column:
        # The j-th common word, at place i, follows i - j content words; the k-th content word follows k, itself left out.
        common = F.transform(F.filter(m, lambda x: x["c"]), lambda x, j: F.struct(x["w"].alias("w"), (x["i"] - j).alias("n")))
        bare = (F.size(m) > 0) & (F.size(m) == F.size(content))
        picked = F.filter(F.transform(content, lambda x, k: F.when(bare & F.substring(F.md5(x["w"].cast("binary")), 1, 1).isin("0", "1"), F.struct(x["w"].alias("w"), (k + 1).alias("n")))), lambda x: x.isNotNull())
        start = F.filter(F.array(F.struct(F.lit("^").alias("w"), F.lit(0).alias("n"))), lambda x: bare)
        chain = lambda a: F.concat_ws(" ", a["w"], *[F.get(content, a["n"] + k)["w"] for k in range(CHAIN)])
        return F.sort_array(F.array_distinct(F.transform(F.concat(start, common, picked), lambda a: F.substring(F.md5(chain(a).cast("binary")), 1, 8))))

    return _let(marked, from_marked)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(signatures_: Column) -> Column:
    """Signatures as 4-byte integers."""
    return F.transform(signatures_, lambda x: (F.conv(x, 16, 10).cast("long") - (1 << 31)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of signatures; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def _key(id_col: str) -> Column:
    """The id; the smallest long for a null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document (distinct id and text): key, third (a third of its code points, rounded down), and before_key and
    before_third of the document before it in descending id order; the first one's is the last document. Documents of
    one id are ordered by a hash of their text. Narrow rows only; no task sees all of them."""
    text = text_of(text_col)
    ids = docs.select(_key(id_col), F.xxhash64(text).alias("h"), F.floor(F.length(text) / 3).cast("long").alias("third")).distinct()
    order = [F.col("id").desc(), F.col("h")]
    n = max(1, min(4096, ids.count() // 2000 + 1))
    dealt = staged(ids.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "order")
    w = Window.partitionBy("part").orderBy(*order)
    before = dealt.withColumn("before", F.lag(F.struct("id", "h", "third")).over(w))
    # The first of each part follows the last of the part before it (parts without rows have none); at most n rows.
    last = dealt.groupBy("part").agg(F.max_by(F.struct("id", "h", "third"), F.struct(-1 - F.col("id"), F.col("h"))).alias("last"))
    ends = last.withColumn("from", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.first("last").over(Window.orderBy(F.col("part").desc())))).select("part", "from")
    return before.join(F.broadcast(ends), "part").select("id", "h", "third", F.coalesce("before", "from").alias("before"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    The edited text has the last third of the code points (rounded down) replaced by the first as many, or all, of the next document
    in descending doc_id order (after the last: the first). Null texts are empty. Texts without words have
    an empty fingerprint; two empty fingerprints are alike (1), an empty and another one not (0). Rows that repeat id and text get
    the same result each; of rows that share only the id, those with the lower text hash come first; a null id comes last. A single document is its own next one.
    An empty table gives an empty result; other columns aren't read.
    """
    text = text_of(text_col)
    rows = docs.select(_key(id_col), F.xxhash64(text).alias("h"), text.alias("text"))
    links = neighbours(docs, id_col, text_col)
    # Each document gives the one before it its beginning and its own signatures, as numbers.
    given = rows.join(links, ["id", "h"]).select(F.col("before.id").alias("id"), F.col("before.h").alias("h"), F.expr("substring(text, 1, cast(before.third as int))").alias("beginning"), numbers(signatures(F.col("text"))).alias("next_set"))
    given = given.groupBy("id", "h").agg(F.first("beginning").alias("beginning"), F.first("next_set").alias("next_set"))
    both = rows.join(given, ["id", "h"])
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.col("beginning"))
    flat = both.select(F.when(F.col("id") != F.lit(_NONE), F.col("id")).alias("doc_id"), "text", "beginning", "next_set").withColumn("edited", edited)
    sets = flat.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("other"), "next_set")
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("other", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(numbers(F.col("own")), F.col("next_set")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness), a < b, of documents with different sets whose likeness reaches the threshold; documents with equal
    sets stand for each other: a and b are the smallest ids of their sets.

    Sets are dealt by length into bands of ratio `threshold`, so a set meets its own band and the next one only. Within it, two similar sets
    share one of the first size - ceil(threshold * size) + 1 signatures of both, in an order that has rare ones first.
    """
    sets = docs.select(F.col(id_col).cast("long").alias("id"), signatures(text_of(text_col)).alias("s")).where(F.size("s") > 0)
    sets = staged(sets.groupBy("s").agg(F.min("id").alias("id")).where("id is not null"), "sets")
    often = sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = sets.select("id", F.explode("s").alias("x")).join(often, "x").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))
    n = F.size("s")
    sized = sets.join(seen, "id").withColumn("n", n).withColumn("band", F.floor(F.log(n.cast("double")) / -math.log(threshold)))
    # Signatures that no other set has come first in the order and can't be shared, so they use up places of the prefix.
    rest = F.greatest(F.lit(0), F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("o")))
    keyed = sized.select("id", "n", "band", F.explode(F.transform(F.slice("o", 1, rest.cast("int")), lambda x: x["x"])).alias("x"))
    right = keyed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), "x")
    pairs = keyed.withColumnRenamed("id", "a").join(right, ["band", "x"]).where((F.col("a") != F.col("b")) & (F.least("n", "nb") >= threshold * F.greatest("n", "nb") - 1e-9))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, other = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    out = pairs.join(left, "a").join(other, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return out.where(F.col("likeness") >= threshold).select("a", "b", "likeness")
