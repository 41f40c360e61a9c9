"""Matching and clustering of table inventories.

An inventory row describes a table-like asset: id, name, fields
array<struct<name,type>>, sources array<struct<connector,database,table>>,
tables array<string>.  Signals are built-in array expressions; the one thing
that has no built-in form, the character ratio of two names, is a pandas UDF
over Arrow batches.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lattiq.checkpoints import cut
from lattiq.operators.components import connected_components
from lattiq.operators.reconcile import GENERIC
from lattiq.session import importable

# Weights, bands, word lists and thresholds of the matching rules.
WEIGHTS = {"name": 0.20, "column": 0.35, "type": 0.15, "source": 0.30}
CLUSTER_WEIGHTS = {"name": 0.0, "column": 0.5, "type": 0.2, "source": 0.3}
CLUSTER_THRESHOLD = 0.80
BANDS = (("Exact", 0.85), ("Strong", 0.65), ("Partial", 0.40), ("Weak", 0.15), ("None", 0.0))
NAME_STOPWORDS = ["the", "a", "an", "of", "and", "datasource", "data", "source", "ds", "model", "semantic", "dataset", "extract", "live", "copy", "final", "v1", "v2", "prod", "dev", "test"]
FUZZY_FLOOR, FUZZY_CAP = 0.6, 0.9
GENERIC_WEIGHT, MIN_IDF_ASSETS, MIN_IDF = 0.25, 8, 0.15
HELPER_TABLES = ["date", "dates", "calendar", "measures", "measure", "parameters", "parameter", "keymeasures"]
GENERIC_TABLES = ["data", "table", "table1", "sheet", "sheet1", "export", "extract", "query", "customsql", "dataset", "output", "results", "result", "temp", "tmp", "staging", "stage", "raw", "import", "source", "main", "default"]
COMPATIBLE = {
    "INTEGER": ["int64", "decimal", "double"],
    "REAL": ["double", "decimal", "int64"],
    "FLOAT": ["double", "decimal", "int64"],
    "NUMBER": ["double", "decimal", "int64"],
    "STRING": ["string"],
    "BOOLEAN": ["boolean"],
    "BOOL": ["boolean"],
    "DATE": ["datetime", "date"],
    "DATETIME": ["datetime", "date"],
    "SPATIAL": ["string", "binary"],
}
CONNECTORS = {
    "sqlserver": "sqlserver",
    "mssql": "sqlserver",
    "azuresql": "sqlserver",
    "azuresqldb": "sqlserver",
    "snowflake": "snowflake",
    "postgres": "postgres",
    "postgresql": "postgres",
    "redshift": "redshift",
    "bigquery": "bigquery",
    "googlebigquery": "bigquery",
    "oracle": "oracle",
    "mysql": "mysql",
    "databricks": "databricks",
    "spark": "databricks",
    "exceldirect": "excel",
    "textscan": "file",
    "hyper": "extract",
}
#: Words in verbose connector names, in the order in which they are looked for.
CONNECTOR_WORDS = (("snowflake", "snowflake"), ("postgres", "postgres"), ("sql server", "sqlserver"), ("sqlserver", "sqlserver"), ("mssql", "sqlserver"), ("sqldb", "sqlserver"), ("redshift", "redshift"), ("bigquery", "bigquery"), ("oracle", "oracle"), ("mysql", "mysql"), ("databricks", "databricks"))
NEAR_TIE, BORDERLINE = 0.10, 0.07
NAME_STRONG, COLUMN_STRONG, SOURCE_STRONG = 0.85, 0.60, 0.50
REVIEW_TIE, REVIEW_FLOOR, REVIEW_HIGH, REVIEW_LOW = 0.07, 0.40, 0.50, 0.20
IMPORTANCE = {"reach": 0.45, "views": 0.40, "certified": 0.15}
REACH_HALF, VIEWS_HALF = 8.0, 500.0
IMPORTANCE_BANDS = (("Critical", 0.62), ("High", 0.38), ("Moderate", 0.17), ("Low", 0.0))

INVENTORY = "id string, name string, fields array<struct<name:string,type:string>>, sources array<struct<connector:string,database:string,table:string>>, tables array<string>"


def token(x: Column) -> Column:
    """Lower case without anything but letters and digits; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")


def name_tokens(x: Column) -> Column:
    """Distinct words of a name without stopwords, unless it has nothing else."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    rest = F.array_except(words, F.array(*map(F.lit, NAME_STOPWORDS)))
    return F.when(F.size(rest) > 0, rest).otherwise(words)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays as sets; two empty sets give ``empty`` (0 in matching, 1 in comparing layouts)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct members that b has; 0 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a)).cast("double")), F.lit(0.0))


@F.pandas_udf(DoubleType())
def character_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def connector(x: Column) -> Column:
    key, low = token(x), F.lower(F.coalesce(x, F.lit("")))
    known = F.create_map(*[F.lit(v) for kv in CONNECTORS.items() for v in kv])
    out = F.when(key == "", "other").when(F.map_contains_key(known, key), known[key])
    for word, canon in CONNECTOR_WORDS:
        out = out.when(F.contains(low, F.lit(word)), canon)
    return out.otherwise(key)


def prepared(inventory: DataFrame) -> DataFrame:
    """An inventory's sets, worked out once for each asset: name token and words, columns with types, source keys."""
    missing = {"fields": "array<struct<name:string,type:string>>", "sources": "array<struct<connector:string,database:string,table:string>>", "tables": "array<string>"}
    for c, kind in missing.items():
        fill = F.array().cast(kind)
        inventory = inventory.withColumn(c, F.coalesce(F.col(c), fill) if c in inventory.columns else fill)
    entries = F.filter(F.transform("fields", lambda f: F.struct(token(f["name"]).alias("k"), F.coalesce(f["type"], F.lit("")).alias("t"))), lambda e: e["k"] != "")
    keys = F.array_distinct(F.transform("entries", lambda e: e["k"]))
    last = F.transform("keys", lambda k: F.element_at(F.filter("entries", lambda e: e["k"] == k), -1)["t"])
    usable = F.filter("sources", lambda s: token(s["table"]) != "")
    helper = lambda t: (t == "") | t.isin(HELPER_TABLES) | F.contains(t, F.lit("swap"))
    all_tables = F.concat(F.transform("sources", lambda s: token(s["table"])), F.transform("tables", token))
    out = inventory.withColumn("entries", entries).withColumn("keys", keys).withColumn("types", last)
    return out.select(
        "id",
        "name",
        token(F.col("name")).alias("token"),
        name_tokens(F.col("name")).alias("words"),
        F.array_sort("keys").alias("keys"),
        F.map_from_arrays("keys", "types").alias("types"),
        F.array_distinct(F.transform(usable, lambda s: F.concat_ws("|", connector(s["connector"]), token(s["database"]), token(s["table"])))).alias("strict"),
        F.array_distinct(F.transform(usable, lambda s: F.concat_ws("|", connector(s["connector"]), token(s["table"])))).alias("loose"),
        F.array_sort(F.array_distinct(F.filter(all_tables, lambda t: ~helper(t)))).alias("tables"),
    )


def with_weights(assets: DataFrame, population: DataFrame) -> DataFrame:
    """Adds ``weights`` (column to weight): generic names weigh a quarter; with eight assets or more, common columns less.

    ``population`` has the assets (prepared) that document frequencies are counted over.
    """
    n = population.select(F.count(F.lit(1)).cast("double").alias("n"))
    df = population.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    each = assets.select("id", F.explode("keys").alias("k")).join(df, "k").crossJoin(F.broadcast(n))  # one row
    idf = F.least(F.greatest(F.ln((F.col("n") + 1) / (F.col("df") + 0.5)) / F.ln(F.col("n") + 1), F.lit(MIN_IDF)), F.lit(1.0))
    w = F.when(F.col("k").isin(sorted(GENERIC)), F.lit(GENERIC_WEIGHT)).otherwise(F.lit(1.0)) * F.when(F.col("n") >= MIN_IDF_ASSETS, idf).otherwise(F.lit(1.0))
    packed = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", w.alias("w")))).alias("weights"))
    return assets.join(packed, "id", "left").withColumn("weights", F.coalesce("weights", F.create_map().cast("map<string,double>")))


def _sum(keys: Column, weights: Column) -> Column:
    return F.aggregate(keys, F.lit(0.0), lambda a, k: a + weights[k])


def score(pairs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds signals and score to pairs whose assets are in the structs ``a`` and ``b`` (prepared, with weights).

    A signal that can't be measured (no physical source on a side) gives its
    weight to the others.
    """
    weights = weights or WEIGHTS
    importable(pairs.sparkSession)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    ratio = F.when((a("token") != "") & (b("token") != "") & (a("token") != b("token")), character_ratio(a("token"), b("token"))).otherwise(F.lit(0.0)) if weights["name"] else F.lit(0.0)
    pairs = pairs.withColumn("_ratio", ratio).withColumn("_shared", F.array_intersect(a("keys"), b("keys")))
    words = jaccard(a("words"), b("words"))
    name = F.when((a("token") != "") & (a("token") == b("token")), F.lit(1.0)).otherwise(F.greatest(words, F.when(F.col("_ratio") >= FUZZY_FLOOR, F.col("_ratio") * FUZZY_CAP).otherwise(F.lit(0.0))))
    both = _sum(F.col("_shared"), a("weights"))
    column = F.coalesce(F.try_divide(both, _sum(a("keys"), a("weights")) + _sum(b("keys"), b("weights")) - both), F.lit(0.0))
    allowed = F.create_map(*[v for k, kinds in COMPATIBLE.items() for v in (F.lit(k), F.array(*map(F.lit, kinds)))])
    left, right = (lambda k: F.upper(F.trim(a("types")[k]))), (lambda k: F.lower(F.trim(b("types")[k])))
    fits = lambda k: (left(k) == "") | (right(k) == "") | ~F.map_contains_key(allowed, left(k)) | F.coalesce(F.array_contains(F.try_element_at(allowed, left(k)), right(k)), F.lit(False))
    kinds = F.coalesce(F.try_divide(F.size(F.filter("_shared", fits)).cast("double"), F.size("_shared").cast("double")), F.lit(0.0))
    common = F.array_intersect(a("tables"), b("tables"))
    tables = jaccard(a("tables"), b("tables"))
    covered = F.when(F.exists(common, lambda t: ~t.isin(GENERIC_TABLES)), coverage(a("tables"), b("tables"))).otherwise(tables)
    comparable = (F.size(a("tables")) > 0) & (F.size(b("tables")) > 0)
    source = F.when(comparable, F.greatest(jaccard(a("strict"), b("strict")), 0.85 * jaccard(a("loose"), b("loose")), 0.7 * covered))
    out = pairs.withColumns({"name_score": F.round(name, 4), "column_score": F.round(column, 4), "type_score": F.round(kinds, 4), "source_score": F.round(source, 4), "shared_columns": F.size("_shared")})
    plain = sum((weights[k] * F.col(f"{k}_score") for k in ("name", "column", "type")), F.lit(0.0))
    base = weights["name"] + weights["column"] + weights["type"]
    total = F.when(F.col("source_score").isNotNull(), (plain + weights["source"] * F.col("source_score")) / (base + weights["source"])).otherwise(plain / (base or 1.0))
    return out.withColumn("score", F.round(total, 4)).drop("_ratio", "_shared")


def band(x: Column, bands=BANDS) -> Column:
    out = None
    for label, least in bands:
        out = (F if out is None else out).when(x >= least, label)
    return out.otherwise(bands[-1][0])


def bucket(tier: Column) -> Column:
    return F.when(tier.isin("Exact", "Strong"), "already_exists").when(tier == "Partial", "partial").otherwise("rebuild")


def sharing(sets: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of ids whose sets may have a Jaccard similarity of ``least`` or more.  sets: id, keys, each id once.

    Of each set the rarest members count, as many as may be missing from a
    similar one and one more: sets that are similar share one of them.  So a
    member that all sets have makes no pairs unless there is little else.
    """
    each = sets.select("id", F.size("keys").alias("n"), F.explode("keys").alias("k"))
    times = each.groupBy("k").agg(F.count(F.lit(1)).alias("times"))
    ranked = each.join(times, "k").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("times", "k"))).alias("all"))
    marks = ranked.select("id", "n", F.explode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("x")).select("id", "n", F.col("x.k").alias("k"))
    a, b = marks.select(F.col("id").alias("a"), F.col("n").alias("na"), "k"), marks.select(F.col("id").alias("b"), F.col("n").alias("nb"), "k")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)
    return a.join(b, "k").filter(near).select("a", "b").distinct()


def names_alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of different name tokens whose character ratio may reach FUZZY_FLOOR; left and right: token.

    A ratio is twice the characters matched over both lengths, and no more
    match than both have as multisets.  So the shorter has 3/7 of the longer
    one's length, as many of a token's characters are matched, and of the
    others and one more, the rarest first, one is in common.
    """
    chars = F.filter(F.split("token", ""), lambda c: c != "")
    # The same character again is another member.
    each = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    of = lambda df: df.select("token").filter("token <> ''").distinct().withColumn("all", each)
    left, right = of(left), of(right)
    times = left.union(right).select(F.explode("all").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("times"))
    share = FUZZY_FLOOR / 2 / (1 - FUZZY_FLOOR / 2)

    def marks(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select("token", "all", F.explode("all").alias("k")).join(times, "k").groupBy("token", "all").agg(F.sort_array(F.collect_list(F.struct("times", "k"))).alias("rare"))
        take = (F.size("all") - F.ceil(F.round(F.size("all") * share, 9)) + 1).cast("int")
        return ranked.select(F.col("token").alias(name), F.col("all").alias(f"{name}_all"), F.explode(F.slice("rare", F.lit(1), take)).alias("x")).select(name, f"{name}_all", F.col("x.k").alias("k"))

    pairs = marks(left, "a").join(marks(right, "b"), "k").filter("a <> b")
    both = F.size(F.array_intersect("a_all", "b_all"))
    return pairs.filter(2 * both >= FUZZY_FLOOR * (F.size("a_all") + F.size("b_all")) - 1e-9).select("a", "b").distinct()


def compare_inventories(left: DataFrame, right: DataFrame, top: int = 3) -> DataFrame:
    """The best ``top`` + 1 candidates of each left asset: left_id, right_id, rank, signals, score, tier, bucket.

    Ties go by right_id.  Scored are pairs that share a column, a table or a
    word of the name, and pairs of names with enough characters in common:
    all others score 0, and of those a left asset can only need the first
    ``top`` + 1 right ids.  So the result is that of scoring every pair.
    """
    a, b = prepared(left), prepared(right)
    population = a.select("id", "keys").union(b.select("id", "keys"))
    packed = lambda df, alias: with_weights(df, population).select(F.struct("*").alias(alias))
    a, b = cut(packed(a, "a")), cut(packed(b, "b"))
    marks = lambda x: F.array_union(F.array_union(F.transform(F.col(f"{x}.keys"), lambda k: F.concat(F.lit("c:"), k)), F.transform(F.col(f"{x}.tables"), lambda k: F.concat(F.lit("t:"), k))), F.transform(F.col(f"{x}.words"), lambda k: F.concat(F.lit("n:"), k)))
    of = lambda df, x: df.select(F.col(f"{x}.id").alias(f"i{x}"), F.col(f"{x}.token").alias(f"t{x}"), F.explode(marks(x)).alias("k"))
    shared = of(a, "a").join(of(b, "b"), "k").select("ia", "ib")
    tokens = lambda df, x: df.select(F.col(f"{x}.id").alias(f"i{x}"), F.col(f"{x}.token").alias("token"))
    alike = names_alike(tokens(a, "a"), tokens(b, "b"))
    alike = tokens(a, "a").join(alike, F.col("token") == F.col("a")).drop("token").join(tokens(b, "b"), F.col("token") == F.col("b")).select("ia", "ib")
    same = tokens(a, "a").filter("token <> ''").join(tokens(b, "b"), "token").select("ia", "ib")
    first = b.select(F.col("b.id").alias("ib")).orderBy("ib").limit(top + 1)
    rest = a.select(F.col("a.id").alias("ia")).join(F.broadcast(first.agg(F.collect_list("ib").alias("ids"))), F.lit(True)).select("ia", F.explode("ids").alias("ib"))  # one row
    ids = shared.union(alike).union(same).union(rest).distinct()
    pairs = ids.join(a, F.col("ia") == F.col("a.id")).join(b, F.col("ib") == F.col("b.id")).select("a", "b")
    scored = score(pairs).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), "name_score", "column_score", "type_score", "source_score", "shared_columns", "score")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id"))
    tier = band(F.col("score"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top + 1).withColumn("tier", tier).withColumn("bucket", bucket(tier))


def assign_one_to_one(candidates: DataFrame) -> DataFrame:
    """Greedy assignment: best score first, each side used once; ties by left_id, then right_id.

    In rounds: a pair that is the best for both of its sides is the one that
    the greedy order would take, so all such pairs are taken at once.
    Candidates never go to the driver.  The best pair left is always taken, so
    rounds end; a chain in which each pair waits for the one before it takes
    as many rounds as it has pairs.
    """
    rest = cut(candidates.filter("score > 0").select("left_id", "right_id", "score"))
    taken = rest.limit(0)
    order = F.struct((-F.col("score")).alias("s"), F.col("left_id").alias("l"), F.col("right_id").alias("r"))
    while not rest.isEmpty():
        by_left = rest.groupBy("left_id").agg(F.min(order).alias("o")).select("o")
        by_right = rest.groupBy("right_id").agg(F.min(order).alias("o")).select("o")
        new = cut(by_left.join(by_right, "o").select(F.col("o.l").alias("left_id"), F.col("o.r").alias("right_id"), (-F.col("o.s")).alias("score")))
        taken = cut(taken.union(new))
        rest = cut(rest.join(new.select("left_id"), "left_id", "left_anti").join(new.select("right_id"), "right_id", "left_anti").select("left_id", "right_id", "score"))
    return taken.withColumn("tier", band(F.col("score")))


def contested(candidates: DataFrame) -> DataFrame:
    """Best matches (not to be rebuilt) with how many left assets claim the same right one."""
    best = candidates.filter("rank = 1 AND bucket <> 'rebuild'")
    claims = best.groupBy("right_id").agg(F.count(F.lit(1)).alias("claims"))
    return best.join(claims, "right_id").withColumn("contested", F.col("claims") > 1)


def unmatched(right: DataFrame, candidates: DataFrame) -> DataFrame:
    """Right assets that no left asset maps to."""
    matched = candidates.filter("rank = 1 AND bucket <> 'rebuild'").select(F.col("right_id").alias("_id"))
    return right.join(matched, right["id"] == F.col("_id"), "left_anti")


def reciprocal(candidates: DataFrame) -> DataFrame:
    """Best matches with ``mutual``: whether the right asset's best suitor is this left asset (ties by left_id)."""
    best = candidates.filter("rank = 1")
    suitor = best.groupBy(F.col("right_id").alias("_right")).agg(F.min(F.struct((-F.col("score")).alias("s"), "left_id")).alias("best"), F.count(F.lit(1)).alias("suitors"))
    return best.join(suitor, F.col("right_id") == F.col("_right")).select(*best.columns, (F.col("best.left_id") == F.col("left_id")).alias("mutual"), "suitors")


def confidence(candidates: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Best matches with ``confidence`` High, Medium or Low in their bucket, margin and corroborating signals.

    ``verdicts`` (left_id, verdict) from value verification overrule structure.
    Being the mutual best counts only where the right asset has several suitors.
    """
    best = reciprocal(candidates)
    runner = candidates.filter("rank = 2").select(F.col("left_id").alias("_l"), F.col("score").alias("runner"))
    best = best.join(runner, F.col("left_id") == F.col("_l"), "left").drop("_l")
    if verdicts is not None:
        best = best.join(verdicts.select(F.col("left_id").alias("_v"), "verdict"), F.col("left_id") == F.col("_v"), "left").drop("_v")
    else:
        best = best.withColumn("verdict", F.lit(None).cast("string"))
    good = F.col("verdict").isin("verified", "compatible")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    won = F.col("mutual") & (F.col("suitors") > 1)
    strong = yes(F.col("name_score") >= NAME_STRONG) + yes(F.col("column_score") >= COLUMN_STRONG) + yes(F.col("source_score") >= SOURCE_STRONG) + yes(won) + yes(good)
    margin = F.greatest(F.lit(0.0), F.col("score") - F.coalesce("runner", F.lit(0.0)))
    best = best.withColumns({"margin": F.round(margin, 3), "strong": strong})
    tie = F.col("runner").isNotNull() & (F.col("score") - F.col("runner") < NEAR_TIE)
    clash = F.col("suitors") > 1
    level = (
        F.when((F.col("bucket") != "rebuild") & (F.col("verdict") == "mismatch"), "Low")
        .when((F.col("bucket") != "rebuild") & good, "High")
        .when((F.col("bucket") == "already_exists") & (F.col("strong") >= 2) & ~tie & ~clash, "High")
        .when((F.col("bucket") == "already_exists") & (F.col("strong") >= 1), "Medium")
        .when((F.col("bucket") == "partial") & (F.col("strong") >= 1) & ~tie, "Medium")
        .when(F.col("bucket") != "rebuild", "Low")
        .when(F.col("score") <= 0.15, "High")
        .when(F.col("score") >= 0.40 - BORDERLINE, "Low")
        .otherwise("Medium")
    )
    return best.withColumn("confidence", level)


def borderline(scored: DataFrame, strong_cut: float = 0.65, partial_cut: float = 0.40, width: float = 0.05) -> DataFrame:
    """Rows of ``confidence`` with ``reasons``: why a decision is on the fence (empty: it is not).

    A column ``logic`` (none, likely, partial, unverified) is used if it is there.
    """
    logic = F.col("logic") if "logic" in scored.columns else F.lit("none")
    tests = (
        ("partial_tier", F.col("bucket") == "partial"),
        ("near_reuse_boundary", F.abs(F.col("score") - strong_cut) <= width),
        ("near_rebuild_boundary", F.abs(F.col("score") - partial_cut) <= width),
        ("low_confidence", (F.col("confidence") == "Low") & (F.col("bucket") != "partial")),
        ("logic_unverified", (F.col("bucket") != "rebuild") & logic.isin("unverified", "partial")),
    )
    return scored.withColumn("reasons", F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull()))


def review(candidates: DataFrame) -> DataFrame:
    """Best matches with ``review``: why someone should look at one (null: the verdict is clear).

    near_tie: two real contenders; renamed: names and columns disagree;
    obscured_source: no physical source to compare; borderline: Partial or
    Weak; likely_rebuild: next to nothing in common.
    """
    runner = candidates.filter("rank = 2").select(F.col("left_id").alias("_l"), F.col("score").alias("_runner"))
    best = candidates.filter("rank = 1").join(runner, F.col("left_id") == F.col("_l"), "left")
    name, column, tier = F.col("name_score"), F.col("column_score"), F.col("tier")
    reason = (
        F.when((F.col("score") >= REVIEW_FLOOR) & (F.col("score") - F.col("_runner") < REVIEW_TIE), "near_tie")
        .when((tier != "None") & ((name >= REVIEW_HIGH) & (column <= REVIEW_LOW) | (column >= REVIEW_HIGH) & (name <= REVIEW_LOW)), "renamed")
        .when(tier.isin("Strong", "Partial", "Weak") & F.col("source_score").isNull(), "obscured_source")
        .when(tier.isin("Partial", "Weak"), "borderline")
        .when(tier == "None", "likely_rebuild")
    )
    return best.select(*candidates.columns, reason.alias("review"))


def logic_parity(calcs: Column, measures: Column) -> Column:
    """none, likely, partial or unverified: whether calculations have measures of the same name."""
    wanted = F.array_distinct(F.filter(F.transform(calcs, token), lambda t: t != ""))
    found = F.size(F.array_intersect(wanted, F.transform(measures, token)))
    return F.when(F.size(wanted) == 0, "none").when(found == 0, "unverified").when(found == F.size(wanted), "likely").otherwise("partial")


def fingerprint(keys: Column, tables: Column) -> Column:
    """Twelve hexadecimal digits that are the same for the same sets of columns and tables."""
    return F.substring(F.sha1(F.concat(F.lit("F:"), F.array_join(F.array_sort(keys), ","), F.lit("|T:"), F.array_join(F.array_sort(tables), ",")).cast("binary")), 1, 12)


def cluster(inventory: DataFrame, threshold: float = CLUSTER_THRESHOLD) -> DataFrame:
    """id, fingerprint, cluster (its least id), size: assets whose structure is the same or nearly so.

    Equal fingerprints are one asset for scoring, so copies cost nothing.  The
    rest are compared where their columns are alike enough for the threshold;
    assets that share none score less than any threshold above the weight of
    the sources.
    """
    w = CLUSTER_WEIGHTS
    if threshold <= w["source"]:
        raise ValueError("a threshold must be above the weight of the sources")
    own = prepared(inventory).withColumn("fingerprint", fingerprint(F.col("keys"), F.col("tables")))
    own = cut(own)
    seeds = own.groupBy("fingerprint").agg(F.min("id").alias("id"))
    reps = own.join(seeds, ["fingerprint", "id"]).dropDuplicates(["fingerprint"])
    ones = F.map_from_entries(F.transform("keys", lambda k: F.struct(k, F.when(k.isin(sorted(GENERIC)), F.lit(GENERIC_WEIGHT)).otherwise(F.lit(1.0)))))
    reps = cut(reps.withColumn("weights", ones).select(F.struct(*[c for c in own.columns if c != "fingerprint"], "weights").alias("a")))
    # With types and sources at their best; generic columns weigh less, so by count as little as this much of that share.
    columns = max(0.0, (threshold - w["type"] - w["source"]) / w["column"] - 1e-3)
    ids = sharing(reps.select("a.id", "a.keys"), columns * GENERIC_WEIGHT).withColumnsRenamed({"a": "ia", "b": "ib"})
    left, right = reps, reps.select(F.col("a").alias("b"))
    pairs = ids.join(left, F.col("ia") == F.col("a.id")).join(right, F.col("ib") == F.col("b.id")).select("a", "b")
    links = score(pairs, CLUSTER_WEIGHTS).filter(F.col("score") >= threshold).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    found = connected_components(seeds.select(F.col("id").alias("node")), cut(links))
    labelled = own.select("id", "fingerprint").join(seeds.select("fingerprint", F.col("id").alias("node")), "fingerprint").join(found, "node").select("id", "fingerprint", F.col("component").alias("cluster"))
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return labelled.join(sizes, "cluster").select("id", "fingerprint", "cluster", "size")


# -- importance and priority ----------------------------------------------------


def importance_score(workbooks: Column, dashboards: Column, views: Column, certified: Column) -> Column:
    """0 to 1 from saturating signals; missing ones give their weight to the rest; null without any."""
    saturate = lambda x, half: F.when(x > 0, x / (x + half)).otherwise(F.lit(0.0))
    reach = F.when(workbooks.isNotNull() | dashboards.isNotNull(), saturate(F.coalesce(workbooks, F.lit(0)) + 2.0 * F.coalesce(dashboards, F.lit(0)), REACH_HALF))
    seen = F.when(views.isNotNull(), saturate(views, VIEWS_HALF))
    endorsed = certified.cast("double")
    parts = list(zip(IMPORTANCE.values(), (reach, seen, endorsed)))
    total = sum((w * F.coalesce(x, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    return F.round(F.try_divide(total, weight), 4)


def importance_level(x: Column) -> Column:
    return F.when(x.isNull(), "Unknown").otherwise(band(x, IMPORTANCE_BANDS))


def usage_priority(workbooks: Column) -> Column:
    return F.when(workbooks.isNull(), "Unknown").when(workbooks >= 5, "High").when(workbooks >= 2, "Medium").when(workbooks == 1, "Low").otherwise("Unused")


def migration_priority(verdict: Column, usage: Column) -> Column:
    named = {"High": "P1", "Medium": "P2", "Low": "P3", "Unused": "P4"}
    out = F.when(verdict == "already_exists", "Reuse")
    for k, v in named.items():
        out = out.when(usage == k, v)
    return out.otherwise("Unprioritized")
