"""The rule pack: every rule reads facts and gives findings; the runner joins them.

A rule is a function from :class:`RuleInput` to a frame with the scope columns and
``severity, conts_key, group_key, field, value, suggestion, message``.  Rules on single rows are
expressions instead, all worked out in one pass over the facts.  Rules are pure;
a finding's fingerprint holds no value, no severity and no message.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import edge_lists, flat_metres, metres_to_edges, near_edges, region_edges
from ..functions.phone_rule import phone_issue
from ..functions.scalars import fixed, similar_names, without_spot
from ..operators.components import connected_components
from ..session import materialize

#: The rules in force; a rule says since which version it counts.
RULESET_VERSION = 2
#: Keys that a message lists before it says how many more there are.
LISTED_KEYS = 5

# The thresholds the rules are defined by.
BOUNDARY_M = 100.0
NEAR_SAME_NAME_M, SAME_POINT_M = 30.0, 0.1
DISTINCT_NAME_MOST = 4
MOSTLY_EMPTY = 0.9
SHARED_IMAGE = 0.5
FUZZY_NAMES_MOST = 50


@dataclass
class RuleInput:
    facts: DataFrame
    rows: DataFrame  # the table the facts come from, for rules on whole content
    regions: DataFrame
    scope: tuple[str, ...]
    row: str
    content: tuple[str, ...]
    region_name: str = "gu_name"
    rings: str = "coordinates"
    fields: dict[str, str] = field(default_factory=dict)

    def of(self, role: str) -> str:
        return self.fields.get(role, role)


_PARTS = ("severity", "conts_key", "group_key", "field", "value", "suggestion", "message")


def _text(value: Column | str | None) -> Column:
    return F.lit(None).cast("string") if value is None else (F.lit(value) if isinstance(value, str) else value)


def _finding(
    frame: DataFrame, scope: tuple[str, ...], severity: Column | str, *, key: Column | str | None = "key", group: Column | None = None,
    where: Column | str | None = None, value: Column | None = None, suggestion: Column | None = None, message: Column | str | None = None,
) -> DataFrame:
    parts = (_text(severity), F.col(key) if isinstance(key, str) else _text(key), *map(_text, (group, where, value, suggestion, message)))
    return frame.select(*scope, *[p.alias(n) for p, n in zip(parts, _PARTS, strict=True)])


def _issue(
    condition: Column | str, severity: Column | str, *, where: Column | str, value: Column | None = None, suggestion: Column | None = None, message: Column | str,
) -> Column:
    """A finding of the row at hand where the condition holds, else null."""
    parts = (_text(severity), F.col("key"), _text(None), *map(_text, (where, value, suggestion, message)))
    return F.when(F.expr(condition) if isinstance(condition, str) else condition, F.struct(*[p.alias(n) for p, n in zip(parts, _PARTS, strict=True)]))


def both_coordinates(x: Column, y: Column) -> Column:
    return F.concat_ws(", ", fixed(x), fixed(y))


def missing_coordinate(i: RuleInput) -> Column:
    return _issue("status = 'missing'", "error", where=i.of("x"), message="the coordinates are missing")


def swapped_coordinate(i: RuleInput) -> Column:
    x, y = F.col("x"), F.col("y")
    return _issue(
        "status = 'swapped'", "error", where=i.of("x"), value=both_coordinates(x, y), suggestion=both_coordinates(y, x), message="longitude and latitude are swapped"
    )


def out_of_range(i: RuleInput) -> Column:
    return _issue("status = 'outOfRange'", "error", where=i.of("x"), value=both_coordinates(F.col("x"), F.col("y")), message="the coordinates lie outside the country")


def phone_format(i: RuleInput) -> Column:
    return _issue(F.col("phone_issue").isNotNull(), F.col("phone_issue.severity"), where=i.of("phone"), value=F.col("phone"), suggestion=F.col("phone_issue.suggestion"), message=F.col("phone_issue.reason"))


def missing_name(i: RuleInput) -> Column:
    return _issue("name = ''", "error", where=i.of("name"), message="the name is missing")


def duplicate_id(i: RuleInput) -> Column:
    return _issue("id_rows > 1", "error", where=i.of("id"), value=F.col("conts_id"), message=F.concat(F.col("id_rows").cast("string"), F.lit(" rows have this id")))


def row_findings(i: RuleInput, issues: Sequence[tuple[str, Callable[[RuleInput], Column]]]) -> DataFrame:
    """Findings of all rules on single rows, with ``rule_id``, in one pass over the facts."""
    facts = i.facts.withColumn("phone_issue", phone_issue(F.col("phone")))
    found = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(rule).alias("rule_id"), c.alias("f"))) for rule, c in ((r, issue(i)) for r, issue in issues)]))
    return facts.select(*i.scope, F.explode(found).alias("_f")).select(*i.scope, *[F.col(f"_f.f.{n}").alias(n) for n in _PARTS], "_f.rule_id")


def key_lists(members: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, n, listed``: the members of each group, the smallest keys named and the others counted.

    Members are ranked within their group before they are gathered, so no more than the keys named come together.
    """
    ranked = members.select(*group, "key", F.row_number().over(Window.partitionBy(*group).orderBy("key", "row_id")).alias("_rank"))
    named = ranked.where(F.col("_rank") <= LISTED_KEYS).groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "key"))), lambda r: r["key"]), ", ").alias("_named"))
    counted = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > LISTED_KEYS, F.concat(F.lit(" and "), (F.col("n") - LISTED_KEYS).cast("string"), F.lit(" more"))).otherwise("")
    return counted.join(named, list(group)).select(*group, "n", F.concat("_named", more).alias("listed"))


def _saying(words: str) -> Column:
    return F.concat(F.col("n").cast("string"), F.lit(f" rows {words}: "), F.col("listed"))


def _in_named_region(i: RuleInput, facts: DataFrame) -> DataFrame:
    """``facts`` with ``named``: the declared region is one of the known ones."""
    known = i.regions.select(F.col(i.region_name).alias("declared")).where("declared is not null").distinct().withColumn("named", F.lit(True))
    return facts.join(known, "declared", "left").withColumn("named", F.coalesce("named", F.lit(False)))


def _metres_to_region(i: RuleInput, frame: DataFrame, region: str, out: str) -> DataFrame:
    edges = edge_lists(i.regions, name=i.region_name, rings=i.rings).withColumnRenamed("region", region)
    return frame.join(edges, region, "left").withColumn(out, metres_to_edges(F.col("x"), F.col("y"), F.col("edges"))).drop("edges")


def outside_city(i: RuleInput) -> DataFrame:
    candidates = materialize(i.facts.where("is_point and status = 'ok' and located is null"))
    near = near_edges(candidates, region_edges(i.regions, name=i.region_name, rings=i.rings), id_column="row_id", x="x", y="y", metres=BOUNDARY_M)
    far = _in_named_region(i, candidates.join(near.withColumnRenamed("id", "row_id"), "row_id", "left_anti"))
    claims = F.coalesce(F.col("addr_in_city"), F.col("named"))
    consistent = (F.col("addr_in_city") == F.lit(False)) & ~claims
    far = far.withColumns({"claims": claims, "consistent": F.coalesce(consistent, F.lit(False))})
    single = _finding(
        far.where("not consistent"), i.scope, F.when(F.col("claims"), "error").otherwise("suspect"), where=i.of("x"),
        value=both_coordinates(F.col("x"), F.col("y")), message="the point lies outside the city",
    )
    counted = far.where("consistent").groupBy(*i.scope).agg(F.count(F.lit(1)).alias("n"))
    return single.unionByName(_finding(counted, i.scope, "info", key=None, group=F.lit("outside"), value=F.col("n").cast("string"), message=F.concat(F.col("n").cast("string"), F.lit(" points lie outside the city"))))


def region_against_coordinate(i: RuleInput) -> DataFrame:
    differs = _in_named_region(i, i.facts.where("located is not null and declared <> '' and declared <> located"))
    at_point = i.facts.where("point_key is not null").groupBy(*i.scope, "point_key").agg(F.countDistinct("norm").alias("names"))
    joined = _metres_to_region(i, differs.join(at_point, [*i.scope, "point_key"], "left"), "declared", "metres")
    agrees = F.coalesce(F.col("addr_gu") == F.col("located"), F.lit(False))
    declared_agrees = F.coalesce(F.col("addr_gu") == F.col("declared"), F.lit(False))
    far, shared = F.col("metres") > BOUNDARY_M, F.coalesce(F.col("names"), F.lit(1)) > 1
    known = F.col("named")
    severity = F.when(known & agrees & ~shared & far, "error").otherwise("suspect")
    suggestion = F.when(~known | (agrees & ~shared) | (~agrees & ~declared_agrees), F.col("located"))
    return _finding(joined.where(~known | agrees | far), i.scope, severity, where=i.of("region"), value=F.col("declared"), suggestion=suggestion, message=F.concat(F.lit("the coordinates lie in "), "located"))


def region_against_address(i: RuleInput) -> DataFrame:
    differs = _in_named_region(i, i.facts.where("addr_gu is not null and declared <> addr_gu")).where(
        F.col("named") & ~F.coalesce(F.col("located") == F.col("addr_gu"), F.lit(False))
    )
    joined = _metres_to_region(i, differs, "addr_gu", "metres")
    placed = F.coalesce(F.col("located") == F.col("declared"), F.lit(False))
    return _finding(
        joined.where(~placed | (F.col("metres") > BOUNDARY_M)), i.scope, "suspect", where=F.when(placed, F.col("addr_field")).otherwise(F.lit(i.of("region"))),
        value=F.when(placed, F.col("addr_gu")).otherwise(F.col("declared")), message=F.concat(F.lit("the address names "), "addr_gu"),
    )


def region_blank(i: RuleInput) -> DataFrame:
    share = i.facts.groupBy(*i.scope).agg(F.count_if(F.col("declared") == "").alias("blank"), F.count(F.lit(1)).alias("rows"))
    mostly = F.col("blank") / F.col("rows") >= MOSTLY_EMPTY
    whole = _finding(share.where(mostly), i.scope, "info", key=None, group=F.lit("mostly-empty"), where=i.of("region"), value=F.col("blank").cast("string"), message=F.concat(F.col("blank").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" rows have no region")))
    rows = i.facts.where("declared = ''").join(share.where(~mostly).select(*i.scope), list(i.scope), "left_semi")
    return whole.unionByName(_finding(rows, i.scope, "info", where=i.of("region"), suggestion=F.coalesce("located", "addr_gu"), message="the region is blank"))


def _labelled(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` of components of two rows or more, with ``first_key``, the smallest key, ``n`` and ``listed``."""
    joined = materialize(members.join(connected_components(edges).select(F.col("node").alias("row_id"), "component"), "row_id"))
    first = joined.groupBy("component").agg(F.min("key").alias("first_key"))
    return joined.join(first, "component").join(key_lists(joined, ["component"]), "component")


def same_content(i: RuleInput) -> DataFrame:
    values = [x for c in i.content for x in (F.col(c), F.col(c).isNull())]
    hashed = i.rows.select(*i.scope, F.col(i.row).alias("row_id"), F.xxhash64(*values).alias("_h1"), F.xxhash64(F.lit(1), *reversed(values)).alias("_h2"))
    group = [*i.scope, "_h1", "_h2"]
    groups = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    members = materialize(hashed.join(groups, group).join(i.facts.select("row_id", "key"), "row_id"))
    first = members.groupBy(*group).agg(F.min("key").alias("first_key"))
    listed = members.join(first, group).join(key_lists(members, group), group)
    return _finding(listed, i.scope, "suspect", group=F.concat(F.lit("same:"), "first_key"), message=_saying("have the same content"))


def similar_at_point_edges(i: RuleInput) -> DataFrame:
    """``a, b``: rows at one point and of one category whose names are the same or alike."""
    group = [*i.scope, "point_key", "category"]
    points = i.facts.where("point_key is not null and norm <> ''")
    names = materialize(points.groupBy(*group, "norm").agg(F.min("row_id").alias("rep"), F.min_by("name", "key").alias("first_name")))
    sizes = names.groupBy(*group).agg(F.count(F.lit(1)).alias("names")).where(F.col("names").between(2, FUZZY_NAMES_MOST))
    few = names.join(sizes, group)
    left = few.select(*group, F.col("norm").alias("norm_a"), F.col("rep").alias("a"), F.col("first_name").alias("name_a"))
    right = few.select(*group, F.col("norm").alias("norm_b"), F.col("rep").alias("b"), F.col("first_name").alias("name_b"))
    alike = (
        left.join(right, group).where("norm_a < norm_b").where(similar_names(F.col("norm_a"), F.col("norm_b")))
        .where(without_spot(F.col("name_a")) != without_spot(F.col("name_b"))).select("a", "b")
    )
    own = points.join(names.select(*group, "norm", "rep"), [*group, "norm"]).where("row_id <> rep").select(F.col("row_id").alias("a"), F.col("rep").alias("b"))
    return alike.unionByName(own)


def similar_name_at_point(i: RuleInput) -> DataFrame:
    found = _labelled(similar_at_point_edges(i), i.facts)
    return _finding(found, i.scope, "suspect", group=F.concat(F.lit("coord:"), "first_key"), where=i.of("name"), value=F.col("name"), message=_saying("at one point have similar names"))


def duplicate_entry(i: RuleInput) -> DataFrame:
    return same_content(i).unionByName(similar_name_at_point(i))


def near_same_name(i: RuleInput) -> DataFrame:
    counts = i.facts.where("norm <> ''").groupBy(*i.scope, "norm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, DISTINCT_NAME_MOST))
    rare = materialize(i.facts.where("point_key is not null").join(counts.drop("n"), [*i.scope, "norm"]))
    group = [*i.scope, "norm", "category"]
    a = rare.select(*group, F.col("row_id").alias("a"), F.col("key").alias("key_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = rare.select(*group, F.col("row_id").alias("b"), F.col("key").alias("key_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    metres = flat_metres(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    edges = a.join(b, group).where("key_a < key_b").where((metres > SAME_POINT_M) & (metres <= NEAR_SAME_NAME_M)).select("a", "b")
    found = _labelled(edges, rare)
    return _finding(found, i.scope, "suspect", group=F.concat(F.lit("near:"), "first_key"), where=i.of("name"), value=F.col("name"), message=_saying("close by have the same name"))


def shared_image(i: RuleInput) -> DataFrame:
    totals = i.facts.groupBy(*i.scope).agg(F.count(F.lit(1)).alias("rows"))
    counts = i.facts.where("image <> ''").groupBy(*i.scope, "image").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*i.scope).agg(F.min(F.struct((-F.col("n")).alias("least"), "image")).alias("_top")).select(*i.scope, F.col("_top.image").alias("image"), (-F.col("_top.least")).alias("n"))
    found = top.join(totals, list(i.scope)).where((F.col("n") != F.col("rows")) & (F.col("n") / F.col("rows") >= SHARED_IMAGE))
    return _finding(found, i.scope, "info", key=None, group=F.col("image"), where=i.of("image"), value=F.col("image"), message=F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" rows share one image")))


@dataclass(frozen=True)
class Rule:
    """``check`` gives findings, or ``issue`` an expression on a row's facts; ``since`` is the rule set's version that brought it."""

    id: str
    title: str
    check: Callable[[RuleInput], DataFrame] | None = None
    issue: Callable[[RuleInput], Column] | None = None
    since: int = 1


COMMON_RULES: tuple[Rule, ...] = (
    Rule("C-01", "Coordinates are missing", issue=missing_coordinate),
    Rule("C-02", "Longitude and latitude are swapped", issue=swapped_coordinate),
    Rule("C-03", "Coordinates lie out of range", issue=out_of_range),
    Rule("C-04", "The point lies outside the city", outside_city),
    Rule("C-05", "The declared region is not the one of the coordinates", region_against_coordinate),
    Rule("C-06", "The declared region is not the one of the address", region_against_address),
    Rule("C-07", "The declared region is blank", region_blank),
    Rule("C-08", "Entered more than once", duplicate_entry),
    Rule("C-09", "The same name close by", near_same_name, since=2),
    Rule("C-10", "The telephone number is not well formed", issue=phone_format),
    Rule("C-11", "The name is missing", issue=missing_name),
    Rule("C-12", "Many rows share one image", shared_image, since=2),
    Rule("C-15", "The identifier is used more than once", issue=duplicate_id),
)


def in_force(version: Column) -> Column:
    """The common rules' ids of a rule set's version, as an array."""
    return F.filter(
        F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.since).alias("since")) for r in COMMON_RULES]), lambda r: r["since"] <= version
    )["id"]


def run_rules(rules: tuple[Rule, ...], i: RuleInput, *, replaced: DataFrame | None = None) -> DataFrame:
    """Findings of all rules with name and fingerprint.

    ``replaced`` (the last scope column, ``rule_id``) lists common rules that a
    theme's own rules stand in for.  Theme-level findings have a null key and no name.
    """
    issues = [(r.id, r.issue) for r in rules if r.issue]
    frames = [row_findings(i, issues)] if issues else []
    found = reduce(DataFrame.unionByName, frames + [r.check(i).withColumn("rule_id", F.lit(r.id)) for r in rules if r.check])
    theme = i.scope[-1]
    if replaced is not None:
        found = found.join(replaced, [theme, "rule_id"], "left_anti")
    names = i.facts.select(*i.scope, F.col("key").alias("conts_key"), F.nullif("name", F.lit("")).alias("name"))
    named = found.join(names, [*i.scope, "conts_key"], "left")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("rule_id", theme, "conts_key", "group_key", "field")]
    return named.select(*i.scope, "rule_id", *_PARTS, "name", F.concat_ws("|", *parts).alias("fingerprint"))


# --- rules of themes with their own conventions, over parameters -----------------------------------


def id_format(facts: DataFrame, scope: tuple[str, ...], pattern: str, id_field: str) -> DataFrame:
    """Keys that don't follow the theme's pattern; numbered keys of repeated ids never do."""
    return _finding(facts.where(~F.rlike("key", F.lit(pattern))), scope, "error", where=id_field, value=F.col("key"), message="the id does not follow the pattern")


def id_region(facts: DataFrame, scope: tuple[str, ...], parsed: str, region_field: str) -> DataFrame:
    """The region that the id stands for is not the declared one."""
    wrong = facts.where(F.col(parsed).isNotNull() & (F.col(parsed) != F.col("declared")))
    return _finding(wrong, scope, "error", where=region_field, value=F.col("declared"), suggestion=F.col(parsed), message=F.concat(F.lit("the id stands for "), parsed))


def one_per_region(facts: DataFrame, regions: DataFrame, scope: tuple[str, ...], period: str, parsed: str, region_field: str) -> DataFrame:
    """For each period every region must have exactly one row: gaps once, surplus rows each."""
    periods = facts.where(F.col(period).isNotNull()).select(*scope, F.col(period).alias("_period")).distinct()
    # periods times the fixed list of regions: the grid that must be filled
    grid = periods.withColumn("_one", F.lit(1)).join(regions.select(F.col("region").alias("_region")).withColumn("_one", F.lit(1)), "_one").drop("_one")
    have = facts.groupBy(*scope, F.col(period).alias("_period"), F.col(parsed).alias("_region")).agg(F.count(F.lit(1)).alias("n"))
    cell = F.concat_ws("|", "_period", "_region")
    gaps = grid.join(have, [*scope, "_period", "_region"], "left_anti")
    missing = _finding(gaps, scope, "error", key=None, group=cell, where=region_field, message=F.concat(F.lit("no row for "), cell))
    surplus = facts.withColumns({"_period": F.col(period), "_region": F.col(parsed)}).join(have.where("n > 1"), [*scope, "_period", "_region"])
    more = F.concat(F.col("n").cast("string"), F.lit(" rows for "), cell)
    return missing.unionByName(_finding(surplus, scope, "error", group=cell, where=region_field, message=more))


def image_owner(facts: DataFrame, scope: tuple[str, ...], token: Column, own: Column, image_field: str) -> DataFrame:
    """The image's file name carries another row's mark."""
    return _finding(facts.where(token.isNotNull() & (token != own)), scope, "suspect", where=image_field, value=F.col("image"), message=F.concat(F.lit("the image is marked "), token))


def rules_for(rules: DataFrame, replacements: DataFrame, themes: DataFrame) -> DataFrame:
    """``theme_id, rule_id``: the common rules less the replaced ones, then the theme's own.

    ``rules`` has ``rule_id, theme_id`` (null for common rules), ``replacements`` ``theme_id, rule_id``.
    """
    common = themes.select("theme_id").withColumn("_one", F.lit(1)).join(rules.where("theme_id is null").select("rule_id").withColumn("_one", F.lit(1)), "_one").drop("_one")
    kept = common.join(replacements, ["theme_id", "rule_id"], "left_anti")
    own = rules.where("theme_id is not null").select("theme_id", "rule_id").join(themes.select("theme_id"), "theme_id", "left_semi")
    return kept.unionByName(own)
