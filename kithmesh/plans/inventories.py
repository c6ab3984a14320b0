"""Queries of inventories: pruning until nothing falls, decompositions, crosswalks, intervals and counts of steps, with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithmesh.functions import text as tx
from kithmesh.functions.metrics import Watched
from kithmesh.functions.nulls import is_in
from kithmesh.operators import crosswalk, models, relational, similarity, stats, weights
from kithmesh.plans.catalog import _ANOVA, _BASE, _BLOCK, _Tables, _block, _pairs, _present, _query, _roles, _vectors

# --- pruning ---------------------------------------------------------------------------------------------------------------------------

_ROUNDS = 16


def _peeled() -> str:
    """So many rounds of both bounds, by plain counts of what is left: more than the tables need, so the last ones change nothing."""
    out = ["c AS (SELECT DISTINCT s_nationkey::BIGINT * 10 + l_linenumber AS entity, p_brand || p_size AS feature FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)", "p0 AS MATERIALIZED (SELECT * FROM c)"]
    out.append("bound AS MATERIALIZED (SELECT (SELECT floor(0.7 * quantile_disc(n, 0.5)) FROM (SELECT count(*) AS n FROM c GROUP BY feature)) AS f, (SELECT floor(0.7 * quantile_disc(n, 0.5)) FROM (SELECT count(*) AS n FROM c GROUP BY entity)) AS e)")
    for k in range(1, _ROUNDS + 1):
        out.append(f"q{k} AS MATERIALIZED (SELECT * FROM p{k - 1} WHERE feature IN (SELECT feature FROM p{k - 1} GROUP BY feature HAVING count(*) >= (SELECT f FROM bound)))")
        out.append(f"p{k} AS MATERIALIZED (SELECT * FROM q{k} WHERE entity IN (SELECT entity FROM q{k} GROUP BY entity HAVING count(*) >= (SELECT e FROM bound)))")
    return "WITH " + ", ".join(out)


@_query(_peeled() + f" SELECT entity, feature FROM p{_ROUNDS}")
def prune_until_stable(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cells = rows.select((F.col("s_nationkey").cast("long") * 10 + F.col("l_linenumber")).alias("entity"), F.concat("p_brand", F.col("p_size").cast("string")).alias("feature")).distinct().withColumn("value", F.lit(1))
    # The bounds lie under the usual counts, so that rounds follow one another.
    bound = lambda by: int(0.7 * cells.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.expr("percentile_disc(0.5) within group (order by n)")).first()[0])
    return weights.prune_until_stable(cells, bound("feature"), bound("entity")).select("entity", "feature")


# --- decompositions --------------------------------------------------------------------------------------------------------------------


@_query(_BASE + """, cm AS (SELECT i, avg(v) AS m FROM pairs WHERE role = 'control' GROUP BY i), core AS (SELECT i AS entity FROM cm, (SELECT avg(m) AS mid, coalesce(stddev_samp(m), 0) AS sd FROM cm) WHERE m BETWEEN mid - sd AND mid + sd),
un AS (SELECT entity, feature, v / norm AS u FROM vec JOIN norm USING (entity) WHERE norm > 0), cen AS (SELECT feature, sum(u) / (SELECT count(*) FROM core) AS c FROM un SEMI JOIN core USING (entity) GROUP BY feature),
best AS (SELECT j AS entity, arg_min(i, {'v': -v, 'i': i}) AS partner FROM pairs WHERE role = 'interest' GROUP BY j),
a AS (SELECT entity, feature, u * c AS x FROM un JOIN cen USING (feature) SEMI JOIN (SELECT entity FROM roles WHERE role = 'interest') USING (entity) WHERE u * c > 0),
b AS (SELECT un.entity, un.feature, un.u * p.u AS y FROM un JOIN best USING (entity) JOIN un p ON p.entity = best.partner AND p.feature = un.feature WHERE un.u * p.u > 0),
f AS (SELECT entity, feature, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (entity, feature))
SELECT entity, feature, round(x, 9) AS centre, round(coalesce(x / nullif(sum(x) OVER w, 0), 0), 9) AS centre_share, partner, round(y, 9) AS most, round(coalesce(y / nullif(sum(y) OVER w, 0), 0), 9) AS most_share FROM f LEFT JOIN best USING (entity) WINDOW w AS (PARTITION BY entity)""")
def driver_comparison(t):
    r, p = _roles(t), _pairs(t)
    controls = p.join(r.where("role = 'control'").select(F.col("entity").alias("j")), "j", "left_semi")
    core = similarity.core_within(controls, r.where("role = 'study'"))
    return similarity.compared_decompositions(_vectors(t), p, core, r.where("role = 'interest'"))


_NAMES = ("a", "b", "c", "d", "e")


@_query(_BASE + """, mem AS (SELECT DISTINCT 'study' AS set, entity FROM roles WHERE role = 'study' UNION SELECT 'control', entity FROM roles WHERE role = 'control' UNION SELECT 'kin', entity FROM roles WHERE family <= 1 UNION SELECT 'all', entity FROM roles),
sz AS (SELECT set, count(*) AS n FROM mem GROUP BY set), per AS (SELECT feature, set, count(*) AS n FROM pres JOIN mem USING (entity) GROUP BY ALL), nm AS (SELECT entity, row_number() OVER (ORDER BY entity) AS k FROM roles WHERE role = 'interest'),
mk AS (SELECT feature, list(k) AS ks FROM pres JOIN nm USING (entity) GROUP BY feature),
t AS (SELECT feature, idf, """ + ", ".join(f"coalesce((SELECT per.n / sz.n FROM per JOIN sz USING (set) WHERE per.feature = idf.feature AND set = '{s}'), 0) AS p_{s}" for s in ("study", "control", "kin", "all")) + ", " + ", ".join(f"coalesce(list_contains(ks, {k}), FALSE) AS has_{n}" for k, n in enumerate(_NAMES, 1)) + """ FROM idf LEFT JOIN mk USING (feature)),
v AS (SELECT *, has_a::BIGINT + has_b::BIGINT + has_c::BIGINT + has_d::BIGINT + has_e::BIGINT AS shared, CASE WHEN p_study > 0 THEN pow(idf, 6) * p_control * (1 - p_control) * (1 - 2 * p_control) ELSE 0 END AS lev FROM t), c AS (SELECT quantile_cont(lev, 0.9) AS cut FROM v WHERE p_study > 0 AND p_control > 0)
SELECT feature, round(idf, 9) AS idf, """ + ", ".join(f"round(p_{s}, 9) AS p_{s}, round(p_{s} * (1 - p_{s}), 9) AS var_{s}" for s in ("study", "control", "kin", "all")) + """, has_a, has_b, has_c, has_d, has_e, p_control > 0 AND shared = 0 AS control_only, CASE WHEN p_control > 0 THEN shared ELSE 0 END AS n_shared, round(lev, 9) AS leverage, coalesce(lev >= cut, FALSE) AS high,
CASE WHEN coalesce(lev >= cut, FALSE) AND shared > 0 THEN 'both' WHEN lev >= cut THEN 'control tail' WHEN shared > 0 THEN 'interest' ELSE 'neither' END AS flag FROM v, c""")
def driver_profile(t):
    r, p = _roles(t), _present(t)
    named = lambda where, name: r.where(where).select(F.lit(name).alias("set"), "entity")
    sets = named("role = 'study'", "study").unionByName(named("role = 'control'", "control")).unionByName(named("family <= 1", "kin")).unionByName(named("true", "all"))
    interests = [x["entity"] for x in r.where("role = 'interest'").select("entity").distinct().orderBy("entity").collect()]  # one nation's five segments
    padded = [*interests, *[""] * len(_NAMES)][: len(_NAMES)]  # small tables lack some of the segments
    return similarity.driver_profile(p, sets, weights.idf(p), "study", "control", dict(zip(_NAMES, padded, strict=True)))


@_query(_BASE + "SELECT j AS i, i AS j, round(v, 9) AS v FROM sims JOIN dots USING (i, j) WHERE j IN (SELECT entity FROM norm)")
def sparse_cosine(t):
    r = _roles(t)
    return similarity.cosine(_vectors(t), None, r.where("role = 'study'"), dense=False)


# --- crosswalk: symbols made from parts and lines ----------------------------------------------------------------------------------------

#: Letters and marks by a part's size and key; the second inventory writes its marks apart and its letters in the international alphabet.
_LETTERS, _MARKS = "pbtdkgmnszlaeiouščñṭ", ("", "ʲ", "ʰ", "ː", "\u0303", "ʷʰ")


def _symbols(t: _Tables) -> DataFrame:
    letter = F.substring(F.lit(_LETTERS), (F.col("p_size") % len(_LETTERS) + 1).cast("int"), F.lit(1))
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("p_partkey") % len(_MARKS) + 1).cast("int"))
    return t.part.select("p_partkey", "p_brand", letter.alias("letter"), mark.alias("mark"))


def _ours(t: _Tables) -> DataFrame:
    """Brands' symbols; a modification by itself is a row of its own."""
    p = _symbols(t)
    total = t.part.agg(F.count_distinct("p_brand").alias("z"))
    whole = F.col("mark").isin("ʰ", "ʷʰ") & (F.col("p_partkey") % 5 == 0)
    vowel = F.col("letter").isin(*"aeiou")
    each = p.select("p_brand", F.when(whole, F.concat(F.lit("◌"), "mark")).otherwise(tx.nfc(F.concat("letter", "mark"))).alias("symbol"), F.concat(F.when(whole, "mod_").otherwise(""), F.when(vowel, "vowel").otherwise("consonant")).alias("class"))
    n = each.groupBy("symbol", "class").agg(F.count_distinct("p_brand").alias("n")).crossJoin(F.broadcast(total))
    return n.select("symbol", "class", F.log((F.col("z") + 1) / (F.col("n") + 1)).alias("idf"))


def _theirs(t: _Tables) -> DataFrame:
    """Symbols of parts that suppliers sold at no discount; those of other parts occur in none."""
    p = _symbols(t).select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(tx.nfd("letter"), "mark")).otherwise(F.concat(tx.transliterated(F.col("letter")), "mark")).alias("symbol"))
    sold = t.lineitem.where("l_discount = 0 and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    total = t.lineitem.where("l_discount = 0 and l_quantity > 40").agg(F.count_distinct("l_suppkey").alias("z"))
    n = p.join(sold, "p_partkey", "left").groupBy("symbol").agg(F.count_distinct("l_suppkey").alias("n")).crossJoin(F.broadcast(total))
    return n.select("symbol", "n", F.when(F.col("n") > 0, F.log((F.col("z") + 1) / (F.col("n") + 1))).alias("idf"))


def _replaced(c: str, names: dict[str, str]) -> str:
    for old, new in names.items():
        c = f"replace({c}, '{old}', '{new}')"
    return c


#: What the composed letters of these symbols are apart.
_APART = {"š": "s\u030c", "č": "c\u030c", "ñ": "n\u0303", "ṭ": "t\u0323", "ã": "a\u0303", "ẽ": "e\u0303", "ĩ": "i\u0303", "õ": "o\u0303", "ũ": "u\u0303"}
_WRITTEN = {k: v for k, v in tx.AMERICANIST.items() if k in _LETTERS}


def _sql_signature(c: str) -> str:
    found = ", ".join(f"CASE WHEN contains({c}, '{mark}') THEN '{name}' END" for mark, name in tx.MODIFICATIONS.items())
    return f"nullif(array_to_string(list_sort(list_distinct([{found}])), '+'), '')"


def _sql_keys(c: str) -> str:
    apart = _replaced(f"nfc_normalize({c})", _APART)
    marks = "[ʲʰːʷ\u0303\u030c\u0323]"
    return f"[{c}, nfc_normalize({c}), regexp_replace({apart}, '{marks}', '', 'g') || '|' || array_to_string(list_sort(list_distinct(regexp_extract_all({apart}, '{marks}'))), '+')]"


_SYMBOLS = f"""sy AS (SELECT p_partkey, p_brand, substr('{_LETTERS}', p_size % {len(_LETTERS)} + 1, 1) AS letter, ({list(_MARKS)!r})[p_partkey % {len(_MARKS)} + 1] AS mark FROM part),
oe AS (SELECT p_brand, CASE WHEN w THEN '◌' || mark ELSE nfc_normalize(letter || mark) END AS symbol, CASE WHEN w THEN 'mod_' ELSE '' END || CASE WHEN letter IN ('a', 'e', 'i', 'o', 'u') THEN 'vowel' ELSE 'consonant' END AS class FROM (SELECT *, mark IN ('ʰ', 'ʷʰ') AND p_partkey % 5 = 0 AS w FROM sy)),
o AS (SELECT symbol, class, ln(((SELECT count(DISTINCT p_brand) FROM part) + 1) / (count(DISTINCT p_brand) + 1)) AS idf FROM oe GROUP BY symbol, class),
li AS (SELECT l_partkey AS p_partkey, l_suppkey FROM lineitem WHERE l_discount = 0 AND l_quantity > 40),
th AS (SELECT symbol, count(DISTINCT l_suppkey) AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {_replaced("letter", _APART)} ELSE {_replaced("letter", _WRITTEN)} END || mark AS symbol FROM sy) LEFT JOIN li USING (p_partkey) GROUP BY symbol),
t AS (SELECT symbol, n, CASE WHEN n > 0 THEN ln(((SELECT count(DISTINCT l_suppkey) FROM li) + 1) / (n + 1)) END AS idf FROM th)"""

_CROSSWALK = f"""WITH {_SYMBOLS}, b AS (SELECT (SELECT min(idf) FROM o) AS ol, (SELECT max(idf) FROM o) AS oh, (SELECT min(idf) FROM t WHERE n > 0) AS tl, (SELECT max(idf) FROM t WHERE n > 0) AS th),
me AS (SELECT CASE WHEN class = 'mod_vowel' THEN 'v' ELSE 'c' END AS kind, {_sql_signature("symbol")} AS msig, avg(idf) AS mean FROM o WHERE class LIKE 'mod%' GROUP BY ALL),
tk AS (SELECT symbol, n, idf, unnest(range(1, 4)) AS level, unnest({_sql_keys("symbol")}) AS key FROM t), tb AS (SELECT level, key, arg_min({{'symbol': symbol, 'n': n, 'idf': idf}}, {{'n': -n, 's': symbol}}) AS row FROM tk GROUP BY level, key),
ok AS (SELECT symbol, class, idf, unnest(range(1, 4)) AS level, unnest({_sql_keys("written")}) AS key FROM (SELECT *, {_replaced("nfc_normalize(symbol)", _WRITTEN)} AS written FROM o WHERE class NOT LIKE 'mod%')),
om AS (SELECT symbol, class, any_value(idf) AS idf, min(level) FILTER (tb.row IS NOT NULL) AS level, arg_min(tb.row, level) FILTER (tb.row IS NOT NULL) AS m FROM ok LEFT JOIN tb USING (level, key) GROUP BY symbol, class),
u AS (SELECT symbol, class, {_sql_signature(_replaced("nfc_normalize(symbol)", _APART))} AS modification, idf AS oi, CASE WHEN m.n > 0 THEN m.idf END AS ti, TRUE AS in_ours, m IS NOT NULL AS in_theirs, level, NULL::DOUBLE AS mean FROM om
  UNION ALL SELECT symbol, CASE WHEN sig IS NULL THEN '' ELSE 'mod_' END || CASE WHEN v THEN 'vowel' ELSE 'consonant' END, sig, NULL, idf, FALSE, TRUE, NULL, mean FROM (SELECT *, {_sql_signature(_replaced("nfc_normalize(symbol)", _APART))} AS sig, substr({_replaced("nfc_normalize(symbol)", _APART)}, 1, 1) IN ('a', 'e', 'i', 'o', 'u') AS v FROM t WHERE n > 0 AND symbol NOT IN (SELECT m.symbol FROM om WHERE m IS NOT NULL)) x LEFT JOIN me ON me.msig = x.sig AND me.kind = CASE WHEN v THEN 'v' ELSE 'c' END),
s AS (SELECT *, (oi - ol) / nullif(oh - ol, 0) AS ours_idf, (ti - tl) / nullif(th - tl, 0) AS theirs_idf, coalesce((oi - ol) / nullif(oh - ol, 0), (mean - ol) / nullif(oh - ol, 0)) - (ti - tl) / nullif(th - tl, 0) AS d FROM u, b)
"""


@_query(_CROSSWALK + "SELECT symbol, class, modification, round(ours_idf, 9) AS ours_idf, round(theirs_idf, 9) AS theirs_idf, round(d, 9) AS shift, CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '-' WHEN d = 0 THEN '0' END AS direction, in_ours, in_theirs, level FROM s")
def inventory_crosswalk(t):
    return crosswalk.compared(_ours(t), _theirs(t))


@_query(_CROSSWALK + "SELECT CASE WHEN in_ours THEN coalesce(['exact', 'composed', 'letters and marks'][level], 'none') ELSE 'only theirs' END AS how, count(*) AS n, count(d) AS scored FROM s GROUP BY 1")
def crosswalk_levels(t):
    found = crosswalk.compared(_ours(t), _theirs(t))
    how = F.when(F.col("in_ours"), F.coalesce(F.get(F.array(*map(F.lit, crosswalk.LEVELS)), (F.col("level") - 1).cast("int")), F.lit("none"))).otherwise("only theirs")
    return found.groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("n"), F.count("shift").alias("scored"))


# --- intervals ------------------------------------------------------------------------------------------------------------------------

_RISE = "pow(1.959963984540054, 2)"
_DEV = "(n * (k - 1)) * ln({s}) + {sw} / {s} + n * ln({w}) + se / {w}"
_LEAST = f"CASE WHEN se / n > {{sw}} / (n * (k - 1)) THEN {_DEV.format(s='({sw} / (n * (k - 1)))', sw='{sw}', w='(se / n)')} ELSE {_DEV.format(s='(({sw} + se) / (n * k))', sw='{sw}', w='(({sw} + se) / (n * k))')} END"
_ALONG = "(2 * sw / (n * (k - 1) + sqrt(greatest(pow(n * (k - 1), 2) + 4 * (n - se / exp({x})) / exp({x}) * sw, 0))))"
_MID = "((a + b) / 2)"


@_query(_BLOCK.replace("WITH", "WITH RECURSIVE", 1) + _ANOVA + f""", base AS (SELECT n::DOUBLE AS n, k::DOUBLE AS k, sa - se - st AS sw, se, (sa - st) / (n * k) AS p FROM ss),
f AS (SELECT *, {_LEAST.format(sw='sw')} + {_RISE} AS best, CASE WHEN se / n > sw / (n * (k - 1)) THEN sw / (n * (k - 1)) ELSE p END AS s, CASE WHEN se / n > sw / (n * (k - 1)) THEN se / n ELSE p END AS w FROM base),
ends AS (SELECT f.*, v.what, v.a::DOUBLE AS a, v.b::DOUBLE AS b FROM f, LATERAL (VALUES ('half', 0, sqrt(2 * (sw + se) * exp(least({_RISE} / (n * (k - 1)), 600) + 1))), ('s0', ln(s), ln(s) - {_RISE} - 1), ('s1', ln(s), ln(s) + {_RISE} + 2), ('u0', ln(w), ln(p)), ('u1', ln(w), ln(w) + {_RISE} / n + 1.1)) v(what, a, b)),
cut AS (SELECT *, 0 AS step FROM ends UNION ALL SELECT * EXCLUDE (a, b, step, up), CASE WHEN up THEN a ELSE {_MID} END, CASE WHEN up THEN {_MID} ELSE b END, step + 1 FROM (SELECT *, CASE what WHEN 'half' THEN {_LEAST.format(sw=f'(sw + n * {_MID} * {_MID} / 2)')} WHEN 's0' THEN {_DEV.format(s=f'exp({_MID})', sw='sw', w=f'greatest(exp({_MID}), se / n)')}
  WHEN 's1' THEN {_DEV.format(s=f'exp({_MID})', sw='sw', w=f'greatest(exp({_MID}), se / n)')} ELSE {_DEV.format(s=_ALONG.format(x=_MID), sw='sw', w=f'exp({_MID})')} END > best AS up FROM cut WHERE step < 60)),
r AS (SELECT *, {_MID} AS x FROM cut WHERE step = 60), y AS (SELECT what, CASE WHEN what = 'half' THEN x WHEN what IN ('s0', 's1') THEN exp(x / 2) WHEN what = 'u0' AND {_DEV.format(s='p', sw='sw', w='p')} <= best THEN 0 ELSE sqrt(greatest((exp(x) - {_ALONG.format(x='x')}) / k, 0)) END AS x FROM r),
z AS (SELECT max(x) FILTER (what = 'half') AS half, max(x) FILTER (what = 's0') AS s0, max(x) FILTER (what = 's1') AS s1, max(x) FILTER (what = 'u0') AS u0, max(x) FILTER (what = 'u1') AS u1 FROM y),
c AS (SELECT treatment AS term, tm - (SELECT tm FROM tm WHERE treatment = 'A') AS est FROM tm WHERE treatment <> 'A')
SELECT term, round(est, 7) AS estimate, round(est - half, 7) AS low, round(est + half, 7) AS high FROM c, z UNION ALL SELECT 'entity', round(sqrt((w - s) / k), 7), round(u0, 7), round(u1, 7) FROM f, z UNION ALL SELECT 'residual', round(sqrt(s), 7), round(s0, 7), round(s1, 7) FROM f, z""")
def lmm_profile(t):
    p = stats.profile_intervals(_block(t), "A")
    return p.select("term", *[F.round(c, 7).alias(c) for c in ("estimate", "low", "high")])


# --- counts of steps -------------------------------------------------------------------------------------------------------------------


@_query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), l AS (SELECT * FROM o WHERE o_totalprice > 1000), c AS (SELECT l.*, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS credit FROM l LEFT JOIN customer ON c_custkey = o_custkey),
g AS (SELECT c_mktsegment, count(*) AS n, avg(credit) AS mean FROM c GROUP BY 1)
SELECT 0 AS step, 'input' AS name, count(*) AS rows, 0 AS nulls, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high FROM o UNION ALL SELECT 1, 'priced', count(*), 0, min(o_orderkey)::VARCHAR, max(o_orderkey)::VARCHAR FROM l
UNION ALL SELECT 2, 'with customers', count(*), count(*) FILTER (c_mktsegment IS NULL) + count(*) FILTER (credit IS NULL), min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR FROM c
UNION ALL SELECT 3, 'by segment', count(*), count(*) FILTER (c_mktsegment IS NULL) + count(*) FILTER (mean IS NULL), min(c_mktsegment), max(c_mktsegment) FROM g""")
def step_metrics(t):
    w = Watched(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), key="o_orderkey")
    w.then("priced", lambda d: d.where("o_totalprice > 1000"), "o_orderkey")
    credit = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("credit")
    w.then("with customers", lambda d: d.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", credit), "o_custkey", "left"), "o_custkey")
    w.then("by segment", lambda d: d.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("credit").alias("mean")), "c_mktsegment")
    w.frame.write.format("noop").mode("overwrite").save()
    return w.report().drop("about_keys")


# --- null-safe membership, orders, model reports ------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END IN ('BUILDING', 'MACHINERY'), FALSE) AS chosen FROM customer")
def null_safe_membership(t):
    segment = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", segment.alias("segment"), is_in(segment, ["BUILDING", "MACHINERY"]).alias("chosen"))


@_query("SELECT event_type, row_number() OVER (ORDER BY min({'t': ts, 'i': event_id})) AS ord FROM events GROUP BY event_type")
def order_of_appearance(t):
    return relational.appearance_order(t.events, "event_type", ["ts", "event_id"])


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(t):
    return relational.head(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25)


_FITS = "m AS (SELECT l_returnflag AS model, l_linenumber::BIGINT AS obs, -pow(l_quantity - 25.0, 2) / 200 - l_discount AS ll, l_quantity / 10 + l_tax * l_linenumber AS mu FROM lineitem), y AS (SELECT l_linenumber::BIGINT AS obs, avg(l_quantity) / 8 AS y FROM lineitem GROUP BY 1)"


@_query(f"""WITH {_FITS}, tp AS (SELECT model, obs, max(ll) AS top, var_samp(ll) AS p FROM m GROUP BY ALL), e AS (SELECT model, obs, p, top + ln(avg(exp(ll - top))) AS lppd FROM m JOIN tp USING (model, obs) GROUP BY model, obs, top, p),
w AS (SELECT model, -2 * sum(lppd - p) AS waic, sum(p) AS p_waic, sqrt(count(*) * var_samp(-2 * (lppd - p))) AS se FROM e GROUP BY model), r AS (SELECT model, sqrt(avg(pow(y - mu, 2))) AS rmse FROM (SELECT model, obs, avg(mu) AS mu FROM m GROUP BY ALL) JOIN y USING (obs) GROUP BY model)
SELECT model, round(waic, 6) AS waic, round(waic - min(waic) OVER (), 6) AS d_waic, round(p_waic, 6) AS p_waic, round(se, 6) AS se, round(rmse / (SELECT max(y) - min(y) FROM y), 6) AS nrmse FROM w JOIN r USING (model)""")
def model_comparison(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("long").alias("obs"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("draw"), (-F.pow(F.col("l_quantity") - 25.0, F.lit(2)) / 200 - F.col("l_discount")).alias("ll"), (F.col("l_quantity") / 10 + F.col("l_tax") * F.col("l_linenumber")).alias("mu"))
    seen = t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("obs")).agg((F.avg("l_quantity") / 8).alias("y"))
    found = models.compared_fits(rows, rows, seen)
    return found.select("model", *[F.round(c, 6).alias(c) for c in ("waic", "d_waic", "p_waic", "se", "nrmse")])
