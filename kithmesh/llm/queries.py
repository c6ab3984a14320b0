"""The queries opN_<name> over the whole tables, with their production parameters, and DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, fim, mixing, neardup, negatives, packing, quality, repair, sharding, spotsigs, toxicity, warc
from .common import crc_mod, table


#: Wanted shares of tokens by domain. The domain is the language: sources can't be told from texts.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def tokenizer(name: str) -> str:
    """The path of a vocabulary file on this machine; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.train(docs, table(spark, sf_dir, "labels")), TARGETS)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), 40)


def _classified(scored: DataFrame, modulus: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return _classified(toxicity.score(docs, model), 4, 2, 0.3)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, path)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return _classified(quality.score(docs, net), 3, 1, 0.5)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048)


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(repair.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), whole.alias("embedding"))
    found = negatives.mine(rows, F.col("vec_id") % 50 == 0)
    return found.withColumn("positive_score", F.col("positive_score").cast("long")).withColumn("negative_score", F.col("negative_score").cast("long"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_neardup": op2_neardup,
        "op3_mixing": op3_mixing,
        "op4_spotsigs": op4_spotsigs,
        "op5_sharding": op5_sharding,
        "op6_toxicity": op6_toxicity,
        "op7_warc": op7_warc,
        "op8_quality": op8_quality,
        "op9_packing": op9_packing,
        "op10_repair": op10_repair,
        "op11_fim": op11_fim,
        "op12_negatives": op12_negatives,
        "op13_decontamination": op13_decontamination,
    }


def _draw(path: str, name: str) -> str:
    return f"-ln((('0x' || substr(md5(concat_ws('/', k, '{path}', '{name}')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


def _least(path: str, weights: dict[str, float]) -> str:
    draws = ", ".join(f"{{'d': {_draw(path, n)} / {w}::DOUBLE, 'name': '{n}'}}" for n, w in sorted(weights.items()))
    return f"list_min([{draws}]).name"


def _descent(n: int) -> str:
    """The shard of key k in a fleet of n, as a chain of subqueries over d(doc_id, k)."""
    tree: dict = {}
    for leaf in sharding.fleet(n):
        tree.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[str(leaf.shard)] = leaf.weight
    total = lambda t: sum(map(total, t.values())) if isinstance(t, dict) else t
    racks = " ".join(f"WHEN region = '{r}' THEN {_least(r, {x: total(t) for x, t in v.items()})}" for r, v in tree.items())
    shards = " ".join(f"WHEN region = '{r}' AND rack = '{x}' THEN {_least(f'{r}/{x}', t)}" for r, v in tree.items() for x, t in v.items())
    region = _least("", {r: total(v) for r, v in tree.items()})
    return f"SELECT k, (CASE {shards} END)::INTEGER AS shard FROM (SELECT k, region, CASE {racks} END AS rack FROM (SELECT k, {region} AS region FROM (SELECT DISTINCT k FROM d)))"


def _op5_sql() -> str:
    """crc32 is no DuckDB function: its 256 table entries come from the polynomial and are folded over the bytes."""
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    return f"""
WITH RECURSIVE bits(i, n, v) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT i, n + 1, {step} FROM bits WHERE n < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE n = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
a AS ({_descent(40)}), g AS ({_descent(41)})
SELECT d.doc_id, (length(h) // 2 + 16)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'key' AS law, a.shard,
  (row_number() OVER (PARTITION BY a.shard ORDER BY substr(md5(k), 1, 2), doc_id NULLS FIRST) - 1)::BIGINT AS slot, g.shard AS grown_shard
FROM d JOIN a USING (k) JOIN g USING (k) CROSS JOIN crc"""


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT *, list_reduce(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(hex, i + 1, 1))::INTEGER), 4, '0')), lambda x, y: x || y) AS bits FROM s)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('{_B32}', (
    16 * substr(bits, 5 * i + 1, 1)::INTEGER + 8 * substr(bits, 5 * i + 2, 1)::INTEGER + 4 * substr(bits, 5 * i + 3, 1)::INTEGER
    + 2 * substr(bits, 5 * i + 4, 1)::INTEGER + substr(bits, 5 * i + 5, 1)::INTEGER + 1)::BIGINT, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, TRUE AS intact
FROM b"""


def _signatures_sql(text: str) -> str:
    common = ", ".join(f"'{w}'" for w in spotsigs.COMMON)
    words = f"list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    chain = "(a.w || CASE WHEN a.n < len(c) THEN ' ' || c[a.n + 1] ELSE '' END || CASE WHEN a.n + 1 < len(c) THEN ' ' || c[a.n + 2] ELSE '' END)"
    return f"""(SELECT list_sort(list_distinct(list_transform(anchors, lambda a: substr(md5({chain}), 1, 8)))) FROM (
  SELECT c, list_concat(
    CASE WHEN len(w) > 0 AND len(i) = 0 THEN [{{'w': '^', 'n': 0::BIGINT}}] ELSE [] END,
    list_transform(list_zip(i, range(len(i))), lambda z: {{'w': w[z[1]], 'n': (z[1] - 1 - z[2])::BIGINT}}),
    list_transform(list_filter(range(CASE WHEN len(i) = 0 THEN len(c) ELSE 0 END), lambda k: substr(md5(c[k + 1]), 1, 1) IN ('0', '1')), lambda k: {{'w': c[k + 1], 'n': (k + 1)::BIGINT}})) AS anchors
  FROM (SELECT w, list_filter(w, lambda x: x NOT IN ({common})) AS c, list_filter(range(1, len(w) + 1), lambda p: w[p] IN ({common})) AS i FROM (SELECT {words} AS w))))"""


def _op4_sql() -> str:
    like = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(nxt, length(text) // 3) AS edited FROM o),
s AS (SELECT *, {_signatures_sql("text")} AS own, {_signatures_sql("edited")} AS other, {_signatures_sql("nxt")} AS nx FROM e)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint,
  array_to_string(other, '') AS edited_fingerprint, {like("own", "other")} AS near_edited, {like("own", "nx")} AS near_next FROM s"""


# Parts are cut from the text by their lengths; the rebuilt text must be the text.
_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, len(u)::BIGINT AS n, h1 % (len(u) + 1) AS x, h2 % (len(u) + 1) AS y, CASE WHEN len(u) = 0 OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, coalesce(list_sum(list_transform(u[1:least(x, y)], lambda w: length(w))), 0)::BIGINT AS a, coalesce(list_sum(list_transform(u[1:greatest(x, y)], lambda w: length(w))), 0)::BIGINT AS b FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""

_OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_OP13_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM win),
spots AS (SELECT row, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words CROSS JOIN lengths)),
hit AS (SELECT row, k, s, item FROM spots JOIN win USING (k, phrase)),
n_hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT row, s, k FROM hit)) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN n_hit USING (row) LEFT JOIN named USING (row)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_spotsigs": _op4_sql(), "op5_sharding": _op5_sql(), "op7_warc": _OP7_SQL, "op11_fim": _OP11_SQL, "op12_negatives": _OP12_SQL, "op13_decontamination": _OP13_SQL}
