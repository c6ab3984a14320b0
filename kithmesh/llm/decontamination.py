"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions alone (op 13).

Words are runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII. The index holds a posting (term, document, position) for each
occurrence of the terms that it is built for; a term is a 32-bit hash of a word and a document a pair of id and 64-bit text hash. A window of a benchmark
item is found by its rarest terms, by counts over the whole corpus: postings of the rarest one, moved back by its offset in the window, give places where
the window could begin; they are intersected with the postings of the next one, moved by its own offset. What is left, a small part of
the documents, is compared word by word, so hash collisions cost a comparison and change nothing. Windows that hold a term which the corpus doesn't have
are left out at once.

Rows grow with the occurrences of the rarest terms, not with the common words. Tables made from the benchmark are broadcast only if counted to at most
`MOST_ROWS` rows, and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, discard, staged, text_of

WINDOW = 10
RAREST = 2  # terms of a window whose postings are intersected
MOST_ROWS = 500_000
_NONE = -(1 << 63)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), _BREAK), lambda w: w != "")


def terms_of(words: Column, wide: bool = False) -> Column:
    """Hashes of words, of 32 bits or, if wide, of 64."""
    return F.transform(words, lambda w: F.xxhash64(w) if wide else F.hash(w))


def _small(df: DataFrame) -> DataFrame:
    """A staged table with a broadcast hint if it is small enough."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (the smallest long for null), h, text."""
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """id, h, terms of each document, as a staged table: the corpus is cut into words once for counts, postings and lengths."""
    return staged(_documents(docs, id_col, text_col).select("id", "h", terms_of(words_of(F.col("text")), wide).alias("terms")), "terms")


def frequencies(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """t, n: occurrences in the whole corpus of each term (t) that it has."""
    return corpus.select(F.explode("terms").alias("t")).join(_small(terms), "t").groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def postings(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """t, id, h, p: every place (from 0) of each of the terms."""
    each = corpus.select("id", "h", F.posexplode("terms").alias("p", "t"))
    return each.join(_small(terms), "t").select("t", "id", "h", "p")


def windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged tables (w, words) of the different windows of all items, and (w, item) of the items that each is in.

    A window is `n` consecutive words of an item; fewer, but not none, are one window. Item ids are taken as text, null as empty."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_of(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    cut = words.select("item", "words", F.explode(starts).alias("s")).select("item", F.slice("words", F.col("s"), F.lit(n)).alias("words")).distinct()
    cut = staged(cut, "cut")
    # Written before it is read, so a window keeps its number whatever is computed again.
    found = staged(cut.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    owners = staged(cut.join(found, "words").select("w", "item"), "items")
    discard(cut)
    return found, owners


def _keyed(found: DataFrame, counts: DataFrame, most: int | None, wide: bool = False) -> DataFrame:
    """w and keys [(n, t, o)], the terms and offsets of each window that the corpus has all terms of, rarest first, `most` of them."""
    each = found.select("w", F.size("words").alias("size"), F.posexplode(terms_of(F.col("words"), wide)).alias("o", "t")).join(counts, "t")
    keys = each.groupBy("w", "size").agg(F.array_sort(F.collect_list(F.struct("n", "t", "o"))).alias("keys")).where(F.size("keys") == F.col("size"))
    return keys.select("w", F.slice("keys", 1, most).alias("keys") if most else "keys")


def _starts(index: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """w, id, h, s: places where a window may begin: the lists of its two rarest terms, moved by their offsets, agree on them."""
    first, second = F.col("keys")[0], F.get("keys", F.lit(1))
    lists = _small(scratch(keys.select("w", first["t"].alias("t"), first["o"].alias("o"), second["t"].alias("t2"), second["o"].alias("o2")), "lists"))
    at = index.join(lists, "t").select("w", "id", "h", (F.col("p") - F.col("o")).alias("s"), "t2", "o2").where("s >= 0")
    single = at.where("t2 is null").select("w", "id", "h", "s")
    asked = at.where("t2 is not null").select("w", "id", "h", "s", F.col("t2").alias("t"), (F.col("s") + F.col("o2")).alias("p"))
    return single.unionByName(asked.join(index, ["t", "id", "h", "p"]).select("w", "id", "h", "s"))


def phrases(docs: DataFrame, corpus: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """w, id, h, s, n: every occurrence of each window (w, words) in the documents: it begins at word s and has n words. A staged table."""
    scratch = Scratch()
    counts = scratch(frequencies(corpus, scratch(found.select(F.explode(terms_of(F.col("words"))).alias("t")).distinct(), "vocabulary")), "counts")
    keys = scratch(_keyed(found, counts, RAREST), "keys")
    index = scratch(postings(corpus, scratch(keys.select(F.explode("keys.t").alias("t")).distinct(), "rare")), "postings")
    starts = scratch(_starts(index, keys, scratch).distinct(), "starts")
    # Word by word: only documents with a candidate are read again.
    rows = _documents(docs, id_col, text_col).join(_small(scratch(starts.select("id", "h").distinct(), "candidates")), ["id", "h"], "left_semi")
    texts = rows.dropDuplicates(["id", "h"]).select("id", "h", words_of(F.col("text")).alias("all"))
    places = starts.join(found.select("w", F.size("words").alias("n")), "w").groupBy("id", "h").agg(F.collect_list(F.struct("w", "s", "n")).alias("places"))
    seen = texts.join(places, ["id", "h"]).select("id", "h", F.explode(F.transform("places", lambda x: F.struct(x["w"].alias("w"), x["s"].alias("s"), x["n"].alias("n"), F.slice("all", x["s"] + 1, x["n"]).alias("words")))).alias("x"))
    out = staged(seen.select("id", "h", "x.*").join(found, ["w", "words"]).select("w", "id", "h", "s", "n"), "hits")
    scratch.clear()
    return out


def contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with occurring windows), items (their ids as text, sorted),
    contaminated (n_hit > 0) of every row of `docs`.

    Null texts have no words; an item without words has no window. Repeated rows get a result each; null ids are kept. Items that repeat an id count as one;
    a null item id is the empty text. Without documents the result is empty, without items nothing is contaminated. Other columns aren't read."""
    corpus = tokenised(docs, id_col, text_col)
    found, owners = windows(items, n, item_col, item_text_col)
    hits = phrases(docs, corpus, found, id_col, text_col)
    # Occurrences in ascending order; each adds what lies beyond the end of those before it.
    places = F.array_sort(F.collect_set(F.struct("s", F.col("n").alias("k"))))
    end = lambda x: x["s"] + x["k"]
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(places, empty, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], end(x)).alias("end")))
    n_hit = hits.groupBy("id", "h").agg(covered["n"].alias("n_hit"))
    named = hits.select("id", "h", "w").distinct().join(owners, "w").groupBy("id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    facts = staged(n_hit.join(named, ["id", "h"]), "facts")
    discard(found, owners, hits)
    out = corpus.select("id", "h", F.size("terms").cast("long").alias("n_words")).join(facts, ["id", "h"], "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    found_in = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.when(F.col("id") != F.lit(_NONE), F.col("id")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(found_in).cast("long").alias("n_items"), found_in.alias("items"), (n_hit > 0).alias("contaminated"))


def near(docs: DataFrame, queries: DataFrame, span: int = 2 * WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, first, last: proximity matches. A document matches a query (query_id, words array<string>, in lower case) where all its different
    words lie, in any order, within `span` consecutive words. For each occurrence of the query's rarest word in such a run there is the one that begins
    earliest; first is the place of its first word, last that of the word (or of the rarest word) that completes it.

    Postings of the rarest word are joined with those of the other words no more than span - 1 places away. Queries that are null, empty or hold a null
    word match nothing, nor does one with more different words than `span`. Null texts have no words; repeated rows match each, equal runs once; null ids
    are kept; empty tables give an empty result. Words are compared by 64-bit hashes first, so two words that share one could hide a run.
    """
    scratch = Scratch()
    corpus = tokenised(docs, id_col, text_col, wide=True)
    wanted = queries.select("query_id", F.array_distinct("words").alias("words")).where((F.size("words") > 0) & (F.size("words") <= span) & ~F.exists("words", lambda w: w.isNull()))
    wanted = staged(wanted.distinct().withColumn("w", F.monotonically_increasing_id()), "queries")
    vocabulary = scratch(wanted.select(F.explode(terms_of(F.col("words"), True)).alias("t")).distinct(), "vocabulary")
    counts = scratch(frequencies(corpus, vocabulary), "counts")
    keys = scratch(_keyed(wanted.select("w", "words"), counts, None, True).select("w", F.col("keys")[0]["t"].alias("t"), F.transform("keys", lambda x: x["t"]).alias("all")), "keys")
    index = scratch(postings(corpus, vocabulary), "postings")
    block = lambda p: F.floor(p / span)
    rare = index.join(_small(keys), "t").select("w", "id", "h", F.col("p").alias("q"), F.explode("all").alias("t"))
    # A place within span - 1 of q lies in q's block of span places or in one beside it.
    asked = rare.select("*", F.explode(F.array(*[block(F.col("q")) + d for d in (-1, 0, 1)])).alias("b"))
    around = asked.join(index.withColumn("b", block(F.col("p"))), ["t", "id", "h", "b"]).where(F.abs(F.col("p") - F.col("q")) < span)
    runs = around.groupBy("w", "id", "h", "q").agg(F.array_sort(F.collect_set(F.struct("p", "t"))).alias("at")).join(keys.select("w", F.size("all").alias("n")), "w")
    # A run begins with one of the words at or before q, and holds all of them and q.
    inside = lambda s: F.filter("at", lambda x: (x["p"] >= s) & (x["p"] < s + span))
    full = lambda s: (s <= F.col("q")) & (F.col("q") < s + span) & (F.size(F.array_distinct(F.transform(inside(s), lambda x: x["t"]))) == F.col("n"))
    runs = runs.withColumn("first", F.get(F.filter(F.transform("at", lambda x: x["p"]), full), F.lit(0))).where("first is not null").withColumn("at", inside(F.col("first")))
    # It ends where its last missing word has come, or at q if that is later.
    heads = F.transform(F.array_distinct(F.transform("at", lambda x: x["t"])), lambda t: F.array_min(F.transform(F.filter("at", lambda x: x["t"] == t), lambda x: x["p"])))
    runs = staged(runs.select("w", "id", "h", "first", F.greatest(F.array_max(heads), F.col("q")).alias("last")).distinct(), "runs")
    scratch.clear()
    discard(corpus)
    texts = _documents(docs, id_col, text_col).join(_small(staged(runs.select("id", "h").distinct(), "candidates")), ["id", "h"], "left_semi").select("id", "h", words_of(F.col("text")).alias("all"))
    sure = texts.join(runs, ["id", "h"]).join(wanted, "w").where(F.size(F.array_except("words", F.slice("all", F.col("first") + 1, F.col("last") - F.col("first") + 1))) == 0)
    return sure.select("query_id", F.when(F.col("id") != F.lit(_NONE), F.col("id")).alias("doc_id"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
