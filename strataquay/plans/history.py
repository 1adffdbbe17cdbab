"""Run-to-run state: what changed since the last good load, versions, catalogue, totals, guards.

Keys, hashes and findings come from the store of published runs (``published``): a new run is
worked out alone and compared with its predecessors' stored tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.diffs import field_changes, finding_changes, hashed_rows, key_changes, snapshot_hashes
from ..session import materialize
from ..tables import content_columns, table
from . import rules as R
from .facts import row_keys
from .published import RunStore, of_runs
from .rule_queries import SCOPE, findings

THEME, RUN, PREV = "cot_theme_id", "run_tag", "prev_run_tag"
DATES = ("cot_update_date",)
#: Share of themes that may vanish, and of loads that may fail, before a run must stop (fixed values).
MAX_THEME_DROP, MAX_FAILED = 0.2, 0.3
# Load states.
STATES = ("ok", "unavailable", "incomplete", "error", "missing")
SEVERITIES = ("error", "suspect", "info")


def with_departments(catalogue: DataFrame, fresh: DataFrame | None, previous: DataFrame) -> DataFrame:
    """``catalogue`` with ``department, department_stale``.

    ``fresh`` (theme, ``department``) is what the source of departments gave; where it failed (None), every theme
    keeps the department of the ``previous`` catalogue, marked stale if it had one.
    """
    source = previous if fresh is None else fresh
    known = source.select(THEME, F.col("department").alias("_department")).where("_department is not null").dropDuplicates([THEME])
    stale = F.col("_department").isNotNull() if fresh is None else F.lit(False)
    return catalogue.drop("department").join(known, THEME, "left").withColumns({"department": F.coalesce("_department", F.lit("unknown")), "department_stale": stale}).drop("_department")


@dataclass
class History:
    """The derived tables of all runs; each is built once, when first asked for.

    Counts that may be absent are doubles, so that every reader shows them alike.
    """

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def columns(self) -> list[str]:
        return content_columns(self.table("snapshots"))

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("snapshot_runs")

    @cached_property
    def ok_loads(self) -> DataFrame:
        """Usable loads with the usable load before them: ``theme, run, run_no, prev_run``."""
        loads = self.table("theme_loads").where("load_status = 'ok'").select(THEME, RUN).distinct().join(self.runs.select(RUN, "run_no"), RUN)
        return loads.withColumn(PREV, F.lag(RUN).over(Window.partitionBy(THEME).orderBy("run_no")))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.ok_loads.where(f"{PREV} is not null").select(THEME, PREV, RUN)

    @cached_property
    def store(self) -> RunStore:
        return RunStore(self.spark, self.folder)

    @cached_property
    def rows(self) -> DataFrame:
        """Key, name and content hashes of the rows of usable loads, as published per run."""
        snapshots = self.table("snapshots")

        def build(tags: list[str | None]) -> DataFrame:
            keyed = row_keys(snapshots.where(of_runs(F.col(RUN), tags)), scope=SCOPE, id_column="cot_conts_id", order=["row_id"])
            named = keyed.withColumn("name", F.nullif(F.trim("cot_conts_name"), F.lit("")))
            return hashed_rows(named, keep=[RUN, THEME, "row_id", "key", "name"], columns=self.columns, dates=DATES)

        return self.store.read("rows", build).join(self.ok_loads.select(THEME, RUN), [THEME, RUN], "left_semi")

    def keyed(self, wanted: DataFrame) -> DataFrame:
        """Whole rows of the ``wanted`` keys (theme, run, key)."""
        ids = self.rows.join(wanted.select(THEME, RUN, "key").distinct(), [THEME, RUN, "key"], "left_semi").select("row_id", "key")
        return self.table("snapshots").join(ids, "row_id")

    @cached_property
    def sizes(self) -> DataFrame:
        return self.rows.groupBy(THEME, RUN).agg(F.count(F.lit(1)).alias("row_count"))

    @cached_property
    def changes(self) -> DataFrame:
        return materialize(key_changes(self.rows, self.pairs, group=THEME, load=RUN, key="key"))

    @cached_property
    def fields(self) -> DataFrame:
        moved = self.changes.where("change in ('modified', 'dates_only')")
        both = moved.select(THEME, RUN, "key").unionByName(moved.select(THEME, F.col(PREV).alias(RUN), "key"))
        return field_changes(self.keyed(both), moved, group=THEME, load=RUN, key="key", columns=self.columns)

    @cached_property
    def change_counts(self) -> DataFrame:
        """Per compared load ``added, removed, modified, dates_only``."""
        counted = self.changes.groupBy(THEME, PREV, RUN).agg(
            *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "dates_only")]
        )
        return self.pairs.join(counted, [THEME, PREV, RUN], "left").na.fill(0)

    @cached_property
    def hashes(self) -> DataFrame:
        rows = self.table("snapshots").join(self.ok_loads.select(THEME, RUN), [THEME, RUN], "left_semi")
        return snapshot_hashes(rows, scope=SCOPE, columns=self.columns)

    @cached_property
    def findings(self) -> DataFrame:
        return findings(self.spark, self.folder, self.store).join(self.ok_loads.select(THEME, RUN), [THEME, RUN], "left_semi")

    @cached_property
    def finding_counts(self) -> DataFrame:
        """A1: findings of every usable load by severity."""
        counted = self.findings.groupBy(THEME, RUN).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
        return self.ok_loads.select(THEME, RUN).join(counted, [THEME, RUN], "left").na.fill(0, list(SEVERITIES))

    def sides(self, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Findings of both sides of every pair of loads."""
        keep = [THEME, PREV, RUN, "rule_id", "fingerprint", "severity"]
        return (
            before.withColumnRenamed(RUN, PREV).join(self.pairs, [THEME, PREV]).select(*keep),
            after.join(self.pairs, [THEME, RUN]).select(*keep),
        )

    @cached_property
    def finding_diff(self) -> DataFrame:
        return finding_changes(*self.sides(self.findings, self.findings), keys=[THEME, PREV, RUN])

    @cached_property
    def rules_effect(self) -> DataFrame:
        """Changes split into those of the data and those of the rules.

        A run's stored findings are those of the rule set it was checked with.  Where the later load was
        checked with another version, the earlier load is checked again under that version: stored to
        rechecked is the effect of the rules, rechecked to current that of the data.
        """
        versions = self.runs.select(RUN, "ruleset_version")
        jumps = (
            self.pairs.join(versions, RUN).join(versions.select(F.col(RUN).alias(PREV), F.col("ruleset_version").alias("_was")), PREV)
            .where("ruleset_version <> _was")
        )
        keys = [THEME, PREV, RUN]
        before, after = (f.join(jumps, keys) for f in self.sides(self.findings, self.findings))
        under = lambda version: F.array_contains(R.in_force(F.col(version)), F.col("rule_id"))
        stored, rechecked, current = before.where(under("_was")), before.where(under("ruleset_version")), after.where(under("ruleset_version"))
        return finding_changes(stored, rechecked, keys=keys).withColumn("cause", F.lit("rules")).unionByName(
            finding_changes(rechecked, current, keys=keys).withColumn("cause", F.lit("data"))
        )

    @cached_property
    def versions(self) -> DataFrame:
        """The version log: a theme's first usable load and every one whose content changed since the one before."""
        counts = self.change_counts.drop(PREV)
        log = (
            self.ok_loads.join(self.sizes, [THEME, RUN], "left").join(counts, [THEME, RUN], "left").join(self.finding_counts, [THEME, RUN], "left")
            .where(F.col(PREV).isNull() | (F.col("added") + F.col("removed") + F.col("modified") > 0))
        )
        place = F.row_number().over(Window.partitionBy(THEME).orderBy("run_no"))
        newest = F.row_number().over(Window.partitionBy(THEME).orderBy(F.desc("run_no")))  # O11
        return log.select(THEME, place.alias("version"), newest.alias("newest_first"), RUN, F.coalesce("row_count", F.lit(0)).alias("row_count"), *SEVERITIES, *[F.col(c).cast("double").alias(c) for c in ("added", "removed", "modified")])

    @cached_property
    def catalogue(self) -> DataFrame:
        """Every theme's state in the last run, last good figures, and change.

        A theme that failed keeps the figures of its last usable load and has no change.
        """
        newest = self.runs.select(F.max_by(RUN, "run_no").alias(RUN))
        status = self.table("theme_loads").join(newest, RUN).groupBy(THEME).agg(F.max("load_status").alias("status"))
        last = self.ok_loads.join(
            self.ok_loads.groupBy(THEME).agg(F.max("run_no").alias("run_no")), [THEME, "run_no"], "left_semi"
        )
        found = self.finding_diff.groupBy(THEME, PREV, RUN).agg(
            F.count_if(F.col("change") == "added").alias("findings_added"),
            F.count_if(F.col("change") == "resolved").alias("findings_resolved"),
            F.count_if(F.col("change") == "severity_changed").alias("findings_severity_changed"),
        )
        good = (
            last.join(self.sizes, [THEME, RUN], "left").join(self.finding_counts, [THEME, RUN], "left")
            .join(self.runs.select(RUN, F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("last_success_at")), RUN)
            .join(self.change_counts, [THEME, PREV, RUN], "left").join(found, [THEME, PREV, RUN], "left")
        )
        themes = self.table("themes").select(THEME, "thm_theme_name", "thm_theme_type", "department_label")
        out = themes.join(status, THEME, "left").join(good, THEME, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
        compared = (F.col("status") == "ok") & F.col(PREV).isNotNull()
        moves = ["added", "removed", "modified", "dates_only", "findings_added", "findings_resolved", "findings_severity_changed"]
        return materialize(
            out.select(
                THEME, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(THEME)).alias("place"),  # O10; one row a theme
                F.col("thm_theme_name").alias("name"), F.col("thm_theme_type").alias("type"), "status", F.coalesce("department_label", F.lit("unknown")).alias("department"),
                F.coalesce("row_count", F.when(F.col("run_no").isNotNull(), 0)).cast("double").alias("row_count"), *[F.col(c).cast("double").alias(c) for c in SEVERITIES], "last_success_at", compared.alias("compared"),
                *[F.when(compared, F.coalesce(m, F.lit(0))).cast("double").alias(m) for m in moves],
            )
        )

    def status_counts(self) -> DataFrame:
        """A2: themes by state and run, zero-filled; themes without a load are missing."""
        grid = self.runs.select(RUN).withColumn("_one", F.lit(1)).join(self.table("themes").select(THEME).withColumn("_one", F.lit(1)), "_one").drop("_one")
        state = self.table("theme_loads").select(RUN, THEME, "load_status")
        met = grid.join(state, [RUN, THEME], "left").withColumn("load_status", F.coalesce("load_status", F.lit("missing")))
        return met.groupBy(RUN).agg(F.count(F.lit(1)).alias("themes"), *[F.count_if(F.col("load_status") == s).alias(s) for s in STATES])

    def run_totals(self) -> DataFrame:
        """Sums over the themes read in each run; moves are null where nothing was compared."""
        read = self.ok_loads.select(RUN, THEME, PREV)
        met = read.join(self.sizes.withColumnRenamed("row_count", "rows"), [THEME, RUN], "left").join(self.finding_counts, [THEME, RUN], "left").join(self.change_counts.drop(PREV), [THEME, RUN], "left")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        changed = F.col("added") + F.col("removed") + F.col("modified") > 0
        effect = self.rules_effect.where("cause = 'rules' and change <> 'unchanged'").groupBy(RUN).agg(F.count(F.lit(1)).cast("double").alias("rules_effect"))
        totals = met.groupBy(RUN).agg(
            F.count(F.lit(1)).alias("themes_read"), total("rows"), *[total(s) for s in SEVERITIES],
            F.when(F.count(PREV) > 0, F.count_if(changed)).cast("double").alias("themes_changed"), *[F.sum(m).cast("double").alias(m) for m in ("added", "removed", "modified", "dates_only")],
        )
        return totals.join(effect, RUN, "left")

    def guards(self) -> DataFrame:
        """Per run, whether it must stop before anything is written, and why."""
        counts = self.status_counts().join(self.runs.select(RUN, "run_no"), RUN).withColumn("public", F.col("themes") - F.col("missing"))
        before = F.lag("public").over(Window.partitionBy(F.lit(1)).orderBy("run_no"))  # one row a run
        failed = (F.col("error") + F.col("incomplete")) / F.nullif("public", F.lit(0))
        reason = (
            F.when(F.col("public") == 0, "no themes")
            .when(F.col("public_before").isNotNull() & (F.col("public") < F.col("public_before") * (1 - MAX_THEME_DROP)), "too few themes")
            .when(failed > MAX_FAILED, "too many failures")
        )
        return counts.withColumn("public_before", before).select(RUN, "public", F.col("public_before").cast("double").alias("public_before"), F.round(failed, 9).alias("failed_share"), reason.alias("stop"))
