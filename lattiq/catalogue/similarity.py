"""Comparing values, and matching and clustering inventories."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.catalogue.base import register, star, table
from lattiq.checkpoints import cut
from lattiq.operators import reconcile as rec
from lattiq.operators import similarity as sim
from lattiq.operators.relational import values_table


@register(
    "reconcile_two_exprs",
    "SELECT o_orderpriority AS Priority, sum(o_totalprice) / count(o_totalprice) IS NOT NULL AS compared, CASE WHEN abs(sum(o_totalprice) / count(o_totalprice) - avg(o_totalprice)) <= 1e-9 + 1e-9 * avg(o_totalprice) THEN 'agree' ELSE 'differ' END AS verdict FROM orders GROUP BY 1",
)
def _reconcile(spark, sf_dir):
    return rec.compare_expressions(star(spark, sf_dir), "SUM([Total]) / COUNT([Total])", "AVG([Total])", ["Priority"]).select("Priority", F.col("first").isNotNull().alias("compared"), "verdict")


@register("reconcile_verdicts", "SELECT * FROM (VALUES ('same', 'pass'), ('other', 'fail'), ('cross', 'inconclusive')) AS t(name, status)")
def _reconcile_verdicts(spark, sf_dir):
    model = star(spark, sf_dir)
    pairs = {"same": ("SUM([Tax] + [Discount])", "SUM([Tax]) + SUM([Discount])"), "other": ("AVG([Tax])", "MEDIAN([Tax])"), "cross": ("SUM([Tax])", "[Tax]")}
    return values_table(spark, [(n, rec.reconcile(model, *p, dims=["Flag"]).status) for n, p in pairs.items()], "name string, status string")


@register(
    "range_overlap",
    "WITH r AS (SELECT l_returnflag AS flag, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1) SELECT a.flag AS a, b.flag AS b, CASE WHEN greatest(a.lo, b.lo) > least(a.hi, b.hi) THEN 'disjoint' WHEN a.lo = b.lo AND a.hi = b.hi THEN 'equal' WHEN a.lo >= b.lo AND a.hi <= b.hi THEN 'subset' WHEN b.lo >= a.lo AND b.hi <= a.hi THEN 'superset' ELSE 'partial' END AS relation FROM r a, r b WHERE a.flag <= b.flag",
)
def _range_overlap(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    a, b = (r.select(*[F.col(c).alias(f"{c}_{x}") for c in r.columns]) for x in "ab")
    pairs = a.join(b, F.col("l_returnflag_a") <= F.col("l_returnflag_b"))  # three rows each
    return pairs.select(F.col("l_returnflag_a").alias("a"), F.col("l_returnflag_b").alias("b"), rec.range_relationship(*[F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]).alias("relation"))


@register(
    "verify_probes",
    "SELECT c.column, c.function, CASE WHEN c.function = 'SUM' THEN round(c.v, 2) ELSE c.v END AS first, 'agree' AS outcome FROM (SELECT 'o_totalprice' AS column, 'SUM' AS function, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT 'o_totalprice', 'COUNTD', CAST(count(DISTINCT o_totalprice) AS DOUBLE) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') c",
)
def _verify(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    recent = orders.filter("o_orderdate >= TIMESTAMP_NTZ '1996-01-01'")
    windows, probes = rec.plan_probes(recent, orders, measures=["o_totalprice"])
    out = rec.verify_tables(recent, orders, windows, [p for p in probes if p.column == "o_totalprice"])
    return out.select("column", "function", F.round("first", 2).alias("first"), "outcome")


def inventory(spark, sf_dir: str) -> DataFrame:
    """Assets made from all orders: each nation and market segment has, as columns, the kinds of order it has more of than of its kinds on average."""
    orders = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    kinds = orders.groupBy("c_nationkey", "c_mktsegment", F.concat_ws("_", "o_orderpriority", F.year("o_orderdate")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    asset = Window.partitionBy("c_nationkey", "c_mktsegment")
    above = kinds.withColumns({"total": F.sum("n").over(asset), "kinds": F.count(F.lit(1)).over(asset)}).filter("n * kinds > total")
    assets = above.groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list("kind")).alias("cols"))
    fields = F.transform("cols", lambda c: F.struct(c.alias("name"), F.lit("STRING").alias("type")))
    return assets.select(F.concat_ws("-", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), "c_mktsegment").alias("id"), F.lit("x").alias("name"), fields.alias("fields"), F.array().cast("array<struct<connector:string,database:string,table:string>>").alias("sources"), F.array().cast("array<string>").alias("tables"))


_ASSETS = """k AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || c_mktsegment AS id, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') || CAST(year(o_orderdate) AS VARCHAR) AS kind, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
c AS (SELECT id, list(kind) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS total, count(*) OVER (PARTITION BY id) AS kinds FROM k) WHERE n * kinds > total GROUP BY id)"""
_SETS = "WITH " + _ASSETS + """,
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM c a, c b WHERE a.id < b.id) """


@register("jaccard_pairs", _SETS + "SELECT a, b, round(j, 4) AS jaccard FROM p WHERE j >= 0.3")
def _jaccard(spark, sf_dir):
    own = cut(sim.prepared(inventory(spark, sf_dir)).select("id", "keys"))
    a, b = own.select(F.col("id").alias("a"), F.col("keys").alias("ka")), own.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
    j = sim.jaccard(F.col("ka"), F.col("kb"))
    return sim.sharing(own, 0.3).join(a, "a").join(b, "b").filter(j >= 0.3).select("a", "b", F.round(j, 4).alias("jaccard"))


@register(
    "cluster_components",
    _SETS.replace("WITH k", "WITH RECURSIVE k", 1)
    + """, l AS (SELECT a, b FROM p WHERE round((0.5 * round(j, 4) + 0.2 * CASE WHEN j > 0 THEN 1 ELSE 0 END) / 0.7, 4) >= 0.65 UNION SELECT b, a FROM p WHERE round((0.5 * round(j, 4) + 0.2 * CASE WHEN j > 0 THEN 1 ELSE 0 END) / 0.7, 4) >= 0.65),
r AS (SELECT id, id AS to_id FROM c UNION SELECT r.id, l.b FROM r JOIN l ON r.to_id = l.a), m AS (SELECT id, min(to_id) AS cluster FROM r GROUP BY 1)
SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM m""",
)
def _cluster(spark, sf_dir):
    return sim.cluster(inventory(spark, sf_dir), threshold=0.65).select("id", "cluster", "size")


def _rounded(x: str) -> str:
    """To four places by decimal digits, halves up, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE)"


_TIER = "CASE WHEN score >= 0.85 THEN 'Exact' WHEN score >= 0.65 THEN 'Strong' WHEN score >= 0.40 THEN 'Partial' WHEN score >= 0.15 THEN 'Weak' ELSE 'None' END"
#: Every pair of a BUILDING asset and another one; all names are alike, all columns text, and there are no sources.
_CANDIDATES = "WITH RECURSIVE " + _ASSETS + f""",
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM c),
w AS (SELECT kind, CASE WHEN any_value(n.n) >= 8 THEN least(greatest(ln((any_value(n.n) + 1) / (count(*) + 0.5)) / ln(any_value(n.n) + 1), 0.15), 1.0) ELSE 1.0 END AS w FROM (SELECT unnest(s) AS kind FROM c), n GROUP BY kind),
e AS (SELECT id, kind, CAST(w AS DOUBLE) AS w FROM (SELECT id, unnest(s) AS kind FROM c) JOIN w USING (kind)),
t AS (SELECT id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(w ORDER BY kind)), lambda x, y: x + y) AS total FROM e GROUP BY id),
b AS (SELECT l.id AS left_id, r.id AS right_id, l.total AS lt, r.total AS rt FROM t l, t r WHERE contains(l.id, 'BUILDING') AND NOT contains(r.id, 'BUILDING')),
m AS (SELECT l.id AS left_id, r.id AS right_id, count(*) AS shared, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(l.w ORDER BY kind)), lambda x, y: x + y) AS common FROM e l JOIN e r USING (kind) WHERE contains(l.id, 'BUILDING') AND NOT contains(r.id, 'BUILDING') GROUP BY 1, 2),
f AS (SELECT left_id, right_id, coalesce(shared, 0) AS shared, CASE WHEN shared IS NULL THEN 0 ELSE {_rounded("common / (lt + rt - common)")} END AS column_score FROM b LEFT JOIN m USING (left_id, right_id)),
g AS (SELECT *, CAST(1 AS DOUBLE) AS name_score, CAST(shared > 0 AS DOUBLE) AS type_score FROM f),
h AS (SELECT *, {_rounded("(CAST(0.20 AS DOUBLE) * name_score + CAST(0.35 AS DOUBLE) * column_score + CAST(0.15 AS DOUBLE) * type_score) / (CAST(0.20 AS DOUBLE) + CAST(0.35 AS DOUBLE) + CAST(0.15 AS DOUBLE))")} AS score FROM g),
i AS (SELECT *, {_TIER} AS tier, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rank FROM h),
cand AS (SELECT left_id, right_id, name_score, column_score, type_score, CAST(NULL AS DOUBLE) AS source_score, CAST(shared AS INTEGER) AS shared_columns, score, CAST(rank AS INTEGER) AS rank, tier,
                CASE WHEN tier IN ('Exact', 'Strong') THEN 'already_exists' WHEN tier = 'Partial' THEN 'partial' ELSE 'rebuild' END AS bucket FROM i WHERE rank <= 4)"""


@register("inventory_match", _CANDIDATES + " SELECT * FROM cand")
def _match(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return sim.compare_inventories(left, right)


@register(
    "inventory_assignment",
    _CANDIDATES
    + f""", r AS (
SELECT 0 AS step, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS rs, CAST(NULL AS VARCHAR) AS left_id, CAST(NULL AS VARCHAR) AS right_id, CAST(NULL AS DOUBLE) AS score
UNION ALL
SELECT step + 1, list_append(ls, l), list_append(rs, q), l, q, s FROM (
  SELECT r.step, r.ls, r.rs, cand.left_id AS l, cand.right_id AS q, cand.score AS s, row_number() OVER (ORDER BY cand.score DESC, cand.left_id, cand.right_id) AS nth
  FROM r JOIN cand ON cand.score > 0 AND NOT list_contains(r.ls, cand.left_id) AND NOT list_contains(r.rs, cand.right_id)) WHERE nth = 1)
SELECT left_id, right_id, score, {_TIER} AS tier FROM r WHERE step > 0""",
)
def _assignment(spark, sf_dir):
    return sim.assign_one_to_one(sim.compare_inventories(*_sides(spark, sf_dir)))


@register(
    "inventory_confidence",
    _CANDIDATES
    + """, best AS (SELECT * FROM cand WHERE rank = 1),
s AS (SELECT right_id, count(*) AS suitors, arg_min(left_id, (-score, left_id)) AS first FROM best GROUP BY 1),
j AS (SELECT best.*, s.first = best.left_id AS mutual, s.suitors, q.score AS runner, greatest(0, best.score - coalesce(q.score, 0)) AS gap FROM best JOIN s USING (right_id) LEFT JOIN (SELECT left_id, score FROM cand WHERE rank = 2) q USING (left_id)),
v AS (SELECT *, CAST(NULL AS VARCHAR) AS verdict, CAST(round(CAST(CAST(gap AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE) AS margin, CAST(name_score >= 0.85 AS INTEGER) + CAST(column_score >= 0.60 AS INTEGER) + CAST(mutual AND suitors > 1 AS INTEGER) AS strong, runner IS NOT NULL AND score - runner < CAST(0.10 AS DOUBLE) AS tie FROM j),
z AS (SELECT *, CASE WHEN bucket = 'already_exists' AND strong >= 2 AND NOT tie AND suitors = 1 THEN 'High' WHEN bucket = 'already_exists' AND strong >= 1 THEN 'Medium' WHEN bucket = 'partial' AND strong >= 1 AND NOT tie THEN 'Medium' WHEN bucket <> 'rebuild' THEN 'Low' WHEN score <= 0.15 THEN 'High' WHEN score >= CAST(0.40 AS DOUBLE) - CAST(0.07 AS DOUBLE) THEN 'Low' ELSE 'Medium' END AS confidence FROM v)
SELECT * EXCLUDE (gap, tie), concat_ws(',', CASE WHEN bucket = 'partial' THEN 'partial_tier' END, CASE WHEN abs(score - CAST(0.65 AS DOUBLE)) <= CAST(0.05 AS DOUBLE) THEN 'near_reuse_boundary' END, CASE WHEN abs(score - CAST(0.40 AS DOUBLE)) <= CAST(0.05 AS DOUBLE) THEN 'near_rebuild_boundary' END, CASE WHEN confidence = 'Low' AND bucket <> 'partial' THEN 'low_confidence' END) AS reasons FROM z""",
)
def _confidence(spark, sf_dir):
    found = sim.borderline(sim.confidence(sim.compare_inventories(*_sides(spark, sf_dir))))
    return found.withColumn("reasons", F.concat_ws(",", "reasons"))


@register(
    "inventory_review",
    _CANDIDATES
    + """ SELECT cand.*, CASE WHEN cand.score >= 0.40 AND cand.score - q.score < CAST(0.07 AS DOUBLE) THEN 'near_tie' WHEN tier <> 'None' AND (name_score >= 0.5 AND column_score <= 0.2 OR column_score >= 0.5 AND name_score <= 0.2) THEN 'renamed'
WHEN tier IN ('Strong', 'Partial', 'Weak') THEN 'obscured_source' WHEN tier = 'None' THEN 'likely_rebuild' END AS review
FROM cand LEFT JOIN (SELECT left_id, score FROM cand WHERE rank = 2) q USING (left_id) WHERE rank = 1""",
)
def _review(spark, sf_dir):
    return sim.review(sim.compare_inventories(*_sides(spark, sf_dir)))


def _sides(spark, sf_dir):
    own = inventory(spark, sf_dir)
    return own.filter(F.col("id").contains("BUILDING")), own.filter(~F.col("id").contains("BUILDING"))


@register(
    "importance",
    "WITH c AS (SELECT o_custkey, count(*) AS w, count(DISTINCT o_orderpriority) AS d, CAST(round(sum(o_totalprice) / 10000) AS BIGINT) AS v, max(o_orderstatus) = 'P' AS ok FROM orders GROUP BY 1), s AS (SELECT *, round(0.45 * (w + 2.0 * d) / (w + 2.0 * d + 8) + 0.40 * v / (v + 500.0) + 0.15 * ok::INT, 4) AS score FROM c) SELECT o_custkey, score, CASE WHEN score >= 0.62 THEN 'Critical' WHEN score >= 0.38 THEN 'High' WHEN score >= 0.17 THEN 'Moderate' ELSE 'Low' END AS level, CASE WHEN w >= 5 THEN 'High' WHEN w >= 2 THEN 'Medium' WHEN w = 1 THEN 'Low' ELSE 'Unused' END AS usage FROM s",
)
def _importance(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("w"), F.count_distinct("o_orderpriority").alias("d"), F.round(F.sum("o_totalprice") / 10000).cast("bigint").alias("v"), (F.max("o_orderstatus") == "P").alias("ok"))
    score = sim.importance_score(F.col("w"), F.col("d"), F.col("v"), F.col("ok"))
    return c.select("o_custkey", score.alias("score"), sim.importance_level(score).alias("level"), sim.usage_priority(F.col("w")).alias("usage"))


@register("layout_iou", "WITH r AS (SELECT n_nationkey % 5 AS x, n_nationkey // 5 AS y, 2.0::DOUBLE AS w, 1.5::DOUBLE AS h, n_name FROM nation), i AS (SELECT a.n_name AS a, b.n_name AS b, greatest(0, least(a.x, b.x) + 2 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 1.5 - greatest(a.y, b.y)) AS i FROM r a, r b WHERE a.n_name < b.n_name) SELECT a, b, round(i / (6 - i), 4) AS iou FROM i WHERE i > 0")
def _iou(spark, sf_dir):
    from lattiq.operators.layout import iou

    k = F.col("n_nationkey")
    box = F.struct((k % 5).cast("double").alias("x"), F.floor(k / 5).cast("double").alias("y"), F.lit(2.0).alias("w"), F.lit(1.5).alias("h"))
    r = table(spark, sf_dir, "nation").select("n_name", box.alias("box"))
    a, b = r.select(F.col("n_name").alias("a"), F.col("box").alias("p")), r.select(F.col("n_name").alias("b"), F.col("box").alias("q"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("iou", F.round(iou(F.col("p"), F.col("q")), 4)).filter("iou > 0").select("a", "b", "iou")
