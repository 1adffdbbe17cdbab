"""Queries of the rule pack over the snapshot rows of every run, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..tables import content_columns, table
from . import rule_sql
from . import rules as R
from .facts import SNAPSHOT_ROLES, build_facts, named_regions, row_keys
from .published import RunStore, of_runs

CITY = "한빛특별시|한빛시|한빛"
SCOPE = SNAPSHOT_ROLES.scope
_NOT_CONTENT = ("cot_conts_id", "cot_reg_date", "cot_update_date")
FIELDS = {"x": "cot_coord_x", "region": "cot_gu_name", "name": "cot_conts_name", "phone": "cot_tel_no", "image": "cot_img_main_url", "id": "cot_conts_id"}


def rule_input(spark: SparkSession, folder: str, store: RunStore | None = None, runs: list[str | None] | None = None) -> R.RuleInput:
    """What the rules read: published facts of all runs, or of ``runs`` alone."""
    store = store or RunStore(spark, folder)
    rows, regions = table(spark, folder, "snapshots"), table(spark, folder, "district_boundaries")
    content = tuple(c for c in content_columns(rows) if c not in _NOT_CONTENT)

    def facts(tags: list[str | None]) -> DataFrame:
        return build_facts(rows.where(of_runs(F.col("run_tag"), tags)), regions, SNAPSHOT_ROLES, city=CITY, region_name="gu_name", region_part="polygon_no", rings="coordinates")

    known = store.read("facts", facts)
    if runs is not None:
        rows, known = (f.where(of_runs(F.col("run_tag"), runs)) for f in (rows, known))
    return R.RuleInput(facts=known, rows=rows, regions=regions, scope=SCOPE, row="row_id", content=content, fields=FIELDS)


def findings(spark: SparkSession, folder: str, store: RunStore | None = None) -> DataFrame:
    """Findings of every run; only those of runs that aren't published yet are worked out."""
    store = store or RunStore(spark, folder)
    return store.read("findings", lambda tags: R.run_rules(R.COMMON_RULES, rule_input(spark, folder, store, tags)))


def _one(check: Callable[[R.RuleInput], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    return check(rule_input(spark, folder))


def _row_rule(issue: Callable[[R.RuleInput], Column], spark: SparkSession, folder: str) -> DataFrame:
    return R.row_findings(rule_input(spark, folder), [("", issue)]).drop("rule_id")


def facts_all(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of every row."""
    return rule_input(spark, folder).facts.select(
        "row_id", "key", "norm", "status", "is_point", "point_key", "located", F.col("addr_in_city").cast("string").alias("addr_in_city"), "addr_gu", "addr_field"
    )


def row_keys_all(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of all rows."""
    keyed = row_keys(table(spark, folder, "snapshots"), scope=SCOPE, id_column="cot_conts_id", order=["row_id"])
    return keyed.select("row_id", "key", "id_rows")


def row_keys_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """W1, W2 on another binding: order lines by flag."""
    lines = table(spark, folder, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus"]
    return row_keys(lines, scope=["l_returnflag"], id_column="id", order=order).groupBy("l_returnflag", "id_rows").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")
    )


def dup_id_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """R13, W4, D19 on order lines: repeated identifiers with a fingerprint."""
    lines = table(spark, folder, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus"]
    keyed = row_keys(lines, scope=["l_returnflag"], id_column="id", order=order).where("id_rows > 1")
    return keyed.select("l_returnflag", F.lit("error").alias("severity"), F.col("key").alias("conts_key"), F.concat_ws("|", F.lit("C-15"), "l_returnflag", "key", F.lit(""), F.lit("id")).alias("fingerprint"))


def all_findings(spark: SparkSession, folder: str) -> DataFrame:
    return findings(spark, folder)


def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A1: findings by severity per scope, zero-filled."""
    found = findings(spark, folder).groupBy(*SCOPE).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "suspect", "info")])
    scopes = table(spark, folder, "snapshots").select(*SCOPE).distinct()
    return scopes.join(found, list(SCOPE), "left").na.fill(0, ["error", "suspect", "info"])


def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Findings per rule and run with severities, and the rule's place: numbers in an id count as numbers."""
    counted = findings(spark, folder).groupBy("run_tag", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "suspect", "info")]
    )
    number = F.regexp_extract("rule_id", "([0-9]+)$", 1).try_cast("int")
    order = Window.partitionBy("run_tag").orderBy(F.regexp_replace("rule_id", "[0-9]+$", ""), number, "rule_id")  # one row a rule
    return counted.withColumn("place", F.row_number().over(order))


def ordered_findings(spark: SparkSession, folder: str) -> DataFrame:
    """O1: the place of every finding in its load: by rule, key, group and field."""
    order = [F.coalesce(F.col(c), F.lit("")) for c in ("rule_id", "conts_key", "group_key", "field", "value")]
    found = findings(spark, folder)
    return found.select(*SCOPE, "fingerprint", "message", F.row_number().over(Window.partitionBy(*SCOPE).orderBy(*order)).alias("place"))


# --- conventions of single themes, over the whole table --------------------------------------------

_ID_PATTERN = r"^[A-Za-z]+[A-Za-z_-]*[0-9]{9}$"


def _theme_facts(spark: SparkSession, folder: str, i: R.RuleInput) -> DataFrame:
    """Facts with what the ids stand for: number, the region it points to, the period, marks of images."""
    names = table(spark, folder, "district_boundaries").select("gu_name").where("gu_name is not null").distinct()
    ordered = names.withColumn("_place", F.row_number().over(R.Window.orderBy("gu_name")) - 1)  # a few dozen names
    number = F.nullif(F.regexp_extract("conts_id", r"([0-9]{9})$", 1), F.lit("")).cast("bigint")
    size = names.count()
    return (
        i.facts.withColumn("number", number).withColumn("_place", F.pmod("number", F.lit(size)).cast("int"))
        .join(ordered.withColumnRenamed("gu_name", "parsed_region"), "_place", "left")
        .withColumn("period", F.when(F.col("number").isNotNull(), F.floor(F.col("number") / 500).cast("bigint").cast("string")))
        .withColumn("image_mark", F.nullif(F.regexp_extract(F.element_at(F.split("image", "/"), -1), r"^([0-9]+)\.", 1), F.lit("")))
        .withColumn("own_mark", F.col("number").cast("string"))
    )


def id_format(spark: SparkSession, folder: str) -> DataFrame:
    return R.id_format(rule_input(spark, folder).facts, SCOPE, _ID_PATTERN, "cot_conts_id")


def id_region(spark: SparkSession, folder: str) -> DataFrame:
    i = rule_input(spark, folder)
    return R.id_region(_theme_facts(spark, folder, i), SCOPE, "parsed_region", "cot_gu_name")


def one_per_region(spark: SparkSession, folder: str) -> DataFrame:
    i = rule_input(spark, folder)
    facts = materialize(_theme_facts(spark, folder, i).where("number is not null"))
    return R.one_per_region(facts, named_regions(i.regions, "gu_name"), SCOPE, "period", "parsed_region", "cot_gu_name")


def image_owner(spark: SparkSession, folder: str) -> DataFrame:
    i = rule_input(spark, folder)
    return R.image_owner(_theme_facts(spark, folder, i), SCOPE, F.col("image_mark"), F.col("own_mark"), "cot_img_main_url")


def gap_detection(spark: SparkSession, folder: str) -> DataFrame:
    """R16, J15 on orders: month and nation cells of urgent orders that are empty or hold more than one."""
    urgent = table(spark, folder, "orders").where("o_orderpriority like '1-%'").join(
        table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    have = urgent.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    months = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    grid = months.withColumn("_one", F.lit(1)).join(table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.lit(1).alias("_one")), "_one").drop("_one")
    filled = grid.join(have, ["month", "nation"], "left")
    return filled.where("n is null or n > 1").select("month", "nation", F.coalesce("n", F.lit(0)).alias("n"))


#: F2: themes with rules of their own and the common rules these stand in for.
THEME_RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "90010591": (("T-01", "T-02", "T-03", "T-04"), ("C-12",)),
    "90011816": (("T-01", "T-04"), ("C-10", "C-12")),
}
_OWN_RULES = {"T-01": id_format, "T-02": id_region, "T-03": one_per_region, "T-04": image_owner}


def _replacements(spark: SparkSession, theme: str) -> DataFrame:
    return spark.createDataFrame([(t, r) for t, (_, gone) in THEME_RULES.items() for r in gone], f"{theme} string, rule_id string")


def rule_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of every theme: the common ones less the replaced, and its own."""
    themes = table(spark, folder, "themes").select(F.col("cot_theme_id").alias("theme_id"))
    own = spark.createDataFrame([(r.id, None) for r in R.COMMON_RULES] + [(r, t) for t, (rules, _) in THEME_RULES.items() for r in rules], "rule_id string, theme_id string")
    return R.rules_for(own, _replacements(spark, "theme_id"), themes)


def theme_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings of the themes with own rules, the common rules they replace left out."""
    own = spark.createDataFrame([(t, r) for t, (rules, _) in THEME_RULES.items() for r in rules], "cot_theme_id string, rule_id string")
    mine = [f(spark, folder).withColumn("rule_id", F.lit(r)) for r, f in _OWN_RULES.items()]
    found = mine[0]
    for more in mine[1:]:
        found = found.unionByName(more)
    common = findings(spark, folder).join(_replacements(spark, "cot_theme_id"), ["cot_theme_id", "rule_id"], "left_anti").join(own.select("cot_theme_id").distinct(), "cot_theme_id", "left_semi")
    columns = [*SCOPE, "rule_id", "severity", "conts_key", "group_key", "field", "value"]
    return found.join(own, ["cot_theme_id", "rule_id"], "left_semi").select(*columns).unionByName(common.select(*columns))


def near_same_customers(spark: SparkSession, folder: str) -> DataFrame:
    """R9, J4, A6, N1 on another binding: customers of a nation with the same two last letters of the name, metres apart."""
    name = F.right("c_name", F.lit(2))
    facts = table(spark, folder, "customer").select(
        F.lit("all").alias("run_tag"), F.col("c_nationkey").cast("string").alias("cot_theme_id"), F.col("c_custkey").cast("bigint").alias("row_id"), F.col("c_custkey").cast("string").alias("key"),
        name.alias("norm"), name.alias("name"), F.lit("").alias("category"), (F.lit(127.0) + F.pmod("c_custkey", F.lit(7)) * 0.0001).alias("x"), F.lit(37.0).alias("y"), F.lit("").alias("point_key"),
    )
    i = R.RuleInput(facts=facts, rows=facts, regions=facts, scope=SCOPE, row="row_id", content=(), fields={"name": "c_name"})
    return R.near_same_name(i)


def region_extents(spark: SparkSession, folder: str) -> DataFrame:
    """The box around every polygon's rings."""
    rings = table(spark, folder, "district_boundaries").select("gu_name", "polygon_no", F.explode(F.flatten("coordinates")).alias("p"))
    x, y = F.col("p")[0], F.col("p")[1]
    return rings.groupBy("gu_name", "polygon_no").agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def rule_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Rule ids and titles."""
    return spark.createDataFrame([(r.id, r.title) for r in R.COMMON_RULES], "rule_id string, title string")


_ROW_RULES = {
    "missing_coord": R.missing_coordinate, "swapped_coord": R.swapped_coordinate, "out_of_range": R.out_of_range, "phone_findings": R.phone_format,
    "missing_name": R.missing_name, "dup_id_findings": R.duplicate_id,
}
_RULE_QUERIES = {
    "outside_city": R.outside_city, "region_mismatch": R.region_against_coordinate, "address_mismatch": R.region_against_address, "region_blank_ratio": R.region_blank,
    "dup_content": R.same_content, "similar_names": R.similar_name_at_point, "near_same_name": R.near_same_name, "shared_value": R.shared_image,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(_one, check) for name, check in _RULE_QUERIES.items()} | {name: partial(_row_rule, issue) for name, issue in _ROW_RULES.items()} | {
    f.__name__: f
    for f in (
        facts_all, row_keys_all, row_keys_lineitem, dup_id_lineitem, all_findings, severity_counts, rule_counts, id_format, id_region,
        one_per_region, image_owner, gap_detection, rule_dispatch, rule_catalogue, ordered_findings, theme_findings, near_same_customers, region_extents,
    )
}
ORACLE: dict[str, str] = dict(rule_sql.QUERIES)
