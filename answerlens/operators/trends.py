"""Figures over dates: trends against earlier snapshots, history reports, two-date comparison.

``metrics`` has one row per (project, question_id, date, section, entity) with mentions,
influence, rank and model_count.  Look-back counts snapshots of the question, whether or not the
entity was in them.  An earlier snapshot is found by equality on snapshot numbers (each row is
offered to the next ``lookback`` snapshots), so no window holds an entity's whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from answerlens import schemas as S
from answerlens.functions import scores as SC
from answerlens.operators.scale import top_k

LOOKBACK = 3  # fixed value: earlier snapshots looked at for trends
SLOPE_STEADY = 0.01  # fixed value
RESIDUAL_SHARE = 0.1  # fixed value

_QUESTION = ["project", "question_id"]


def snapshot_numbers(df: DataFrame) -> DataFrame:
    """1, 2, … per question in date order; one row per snapshot."""
    order = Window.partitionBy(*_QUESTION).orderBy("date")
    return df.select(*S.SNAPSHOT).distinct().withColumn("snap_no", F.row_number().over(order))


def earlier_values(metrics: DataFrame, item: list[str], lookback: int = LOOKBACK) -> DataFrame:
    """Every row re-dated to each of the next ``lookback`` snapshots; ``prev_date`` is its own date."""
    snaps = snapshot_numbers(metrics)
    values = [c for c in metrics.columns if c not in S.SNAPSHOT + item]
    offered = (
        metrics.join(snaps, S.SNAPSHOT)
        .withColumnRenamed("date", "prev_date")
        .withColumn("snap_no", F.explode(F.sequence(F.col("snap_no") + 1, F.col("snap_no") + lookback)))
    )
    return offered.join(snaps, _QUESTION + ["snap_no"]).select(
        *S.SNAPSHOT, *item, "prev_date", *values
    )


def entity_trends(metrics: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Trend codes, change, first/last seen, volatility and series of each entity.

    The comparison value is the newest of the looked-at snapshots that holds the entity.  A larger
    rank number reads as UP, and dates always come from the row that holds the value.
    """
    measures = ["mentions", "influence", "rank", "model_count"]
    keyed = metrics.withColumn("key", F.lower("entity"))
    item = ["section", "key"]
    past = earlier_values(keyed.select(*S.SNAPSHOT, *item, *measures), item, lookback)
    before = past.groupBy(*S.SNAPSHOT, *item).agg(
        F.max_by(F.struct("prev_date", *measures), "prev_date").alias("prev"),
        F.min("prev_date").alias("oldest"),
        F.sort_array(F.collect_list(F.struct("prev_date", *measures)), asc=False).alias("series"),
        F.count(F.lit(1)).alias("n"),
        F.sum("mentions").alias("s1"),
        F.sum(F.col("mentions") * F.col("mentions")).alias("s2"),
    )
    cur = lambda c: F.coalesce(F.col(c), F.lit(0))
    prev = lambda c: F.col(f"prev.{c}")
    n = F.coalesce("n", F.lit(0)) + 1
    s1 = F.coalesce("s1", F.lit(0)) + cur("mentions")
    s2 = F.coalesce("s2", F.lit(0)) + cur("mentions") * cur("mentions")
    spread = F.sqrt(((n * s2 - s1 * s1) / (n * n)).cast("double"))
    now = F.array(F.struct(F.col("date").alias("prev_date"), *measures))
    series = F.concat(now, F.coalesce("series", F.array().cast(
        "array<struct<prev_date:date,mentions:bigint,influence:double,rank:bigint,model_count:bigint>>"
    )))
    values = lambda c: F.transform(series, lambda p: F.struct(
        p["prev_date"].alias("date"), p[c].cast("double").alias("value")
    ))
    return keyed.join(before, S.SNAPSHOT + item, "left").select(
        *S.ENTITY, *measures,
        SC.trend_code(cur("mentions"), prev("mentions")).alias("mentions_trend"),
        SC.trend_code(cur("influence"), prev("influence")).alias("influence_trend"),
        SC.order_trend_code(F.coalesce("rank", F.lit(S.UNKNOWN_RANK)), prev("rank")).alias("rank_trend"),
        SC.trend_code(cur("model_count"), prev("model_count")).alias("model_count_trend"),
        F.coalesce(prev("mentions"), F.lit(0)).cast("long").alias("previous_mentions"),
        (cur("mentions") - F.coalesce(prev("mentions"), F.lit(0))).cast("long").alias("mentions_change"),
        SC.change_percent(cur("mentions"), prev("mentions")).alias("change_percent"),
        F.coalesce("oldest", F.col("date")).alias("first_seen"),
        F.col("date").alias("last_seen"),
        SC.rounded(spread, 2).alias("volatility"),
        *[values(c).alias(f"{c}_series") for c in measures],
    )


def entity_model_trends(
    metrics: DataFrame, model_facts: DataFrame, models: DataFrame, lookback: int = LOOKBACK
) -> DataFrame:
    """Trend codes per entity and model of the project.

    ``model_facts`` has mentions, influence and rank per model; a missing cell counts as 0, a
    missing rank as -1 on both sides (so a rank after an absence reads as UP).
    """
    keyed = metrics.select(*S.ENTITY, F.lower("entity").alias("key"))
    past = earlier_values(keyed.select(*S.SNAPSHOT, "section", "key"), ["section", "key"], lookback)
    last = past.groupBy(*S.SNAPSHOT, "section", "key").agg(F.max("prev_date").alias("prev_date"))
    cells = keyed.join(last, S.SNAPSHOT + ["section", "key"], "left").join(
        models.select("project", "model_id"), "project"
    )
    facts = model_facts.select(
        *S.SECTION, F.lower("entity").alias("key"), "model_id", "mentions", "influence", "rank"
    )
    then = facts.select(
        "project", "question_id", "section", "key", "model_id",
        F.col("date").alias("prev_date"), F.col("mentions").alias("mentions0"),
        F.col("influence").alias("influence0"), F.col("rank").alias("rank0"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = lambda c: F.coalesce(F.col(c), F.lit(S.NOT_MENTIONED))
    return (
        cells.join(facts, S.SECTION + ["key", "model_id"], "left")
        .join(then, _QUESTION + ["section", "key", "model_id", "prev_date"], "left")
        .select(
            *S.ENTITY, "model_id",
            SC.trend_code(zero("mentions"), zero("mentions0")).alias("mentions_trend"),
            SC.trend_code(zero("influence"), zero("influence0")).alias("influence_trend"),
            SC.order_trend_code(none("rank"), none("rank0")).alias("rank_trend"),
        )
    )


def item_history(metrics: DataFrame, start=None, end=None) -> DataFrame:
    """Per entity over the reports of a period: span, totals, peak, trend score and label.

    Score: slope of mentions over the report sequence relative to their mean, within -1..1.
    Label: volatile when the population deviation exceeds half the mean, else by the score.
    """
    df = metrics
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end))
    item = _QUESTION + ["section", "entity"]
    numbered = df.withColumn(
        "idx", F.row_number().over(Window.partitionBy(*item).orderBy("date")) - 1
    )
    per_item = numbered.groupBy(*item).agg(
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.count(F.lit(1)).alias("reports"),
        F.sum("mentions").alias("total_mentions"),
        F.avg("mentions").alias("average_mentions"),
        F.max("mentions").alias("peak_mentions"),
        # The earliest date among those with the peak.
        F.max_by("date", F.struct("mentions", -F.unix_date("date"))).alias("peak_date"),
        F.regr_slope(F.col("mentions").cast("double"), F.col("idx").cast("double")).alias("slope"),
        F.stddev_pop("mentions").alias("sd"),
        F.sort_array(F.collect_list(F.struct("date", "mentions", "influence", "rank"))).alias("history"),
    )
    mean = F.col("average_mentions")
    score = F.when(
        (F.col("reports") >= 2) & (mean > 0),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("slope") / mean)),
    ).otherwise(F.lit(0.0))
    cv = F.when((F.col("reports") >= 2) & (mean > 0), F.col("sd") / mean).otherwise(F.lit(0.0))
    return (
        per_item.withColumn("trend_score", score)
        .withColumn("variation", cv)
        .withColumn("trend", trend_label(F.col("trend_score"), F.col("variation")))
        .drop("slope", "sd")
    )


def trend_label(score, variation):
    """volatile / rising / falling / stable."""
    return (
        F.when(variation > 0.5, "volatile").when(score > 0.2, "rising")
        .when(score < -0.2, "falling").otherwise("stable")
    )


def item_history_by_model(facts: DataFrame) -> DataFrame:
    """Mentions per entity and model summed over the reports."""
    return facts.groupBy(*_QUESTION, "section", "entity", "model_id").agg(
        F.sum("mentions").alias("mentions")
    )


_TIES = ["entity", "section", "question_id"]


def top_movers(history: DataFrame, n: int = 10) -> DataFrame:
    """Per project the first ``n`` rising, falling, volatile and stable items."""
    order = (
        F.when(F.col("trend") == "rising", F.col("trend_score"))
        .when(F.col("trend") == "falling", -F.col("trend_score"))
        .when(F.col("trend") == "volatile", F.col("variation"))
        .otherwise(F.col("average_mentions"))
    )
    listed = history.filter((F.col("trend") != "stable") | (F.col("average_mentions") > 0))
    return top_k(
        listed.withColumn("sort_value", order), ["project", "trend"],
        [F.desc("sort_value"), *_TIES], n,
    )


def entrants_leavers(history: DataFrame, metrics: DataFrame, n: int = 10) -> DataFrame:
    """Items first seen in the last quarter of the reports, and items last seen before it."""
    dates = metrics.select("project", "date").distinct()
    per_project = Window.partitionBy("project").orderBy("date")
    counts = dates.groupBy("project").agg(F.count(F.lit(1)).alias("reports_n"))
    threshold = (
        dates.withColumn("no", F.row_number().over(per_project))
        .join(counts, "project")
        .filter(F.col("no") == F.floor(F.col("reports_n") * 0.75) + 1)
        .select("project", F.col("date").alias("threshold"))
    )
    kind = F.when(F.col("first_seen") >= F.col("threshold"), "entrant").when(
        F.col("last_seen") < F.col("threshold"), "leaver"
    )
    listed = history.join(threshold, "project").withColumn("list", kind).filter(F.col("list").isNotNull())
    return top_k(listed, ["project", "list"], [F.desc("average_mentions"), *_TIES], n)


def category_summary(history: DataFrame) -> DataFrame:
    """Per section: number of items and mean trend score."""
    return history.groupBy("project", "section").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.avg("trend_score").alias("average_growth"),
        F.sum("total_mentions").alias("total_mentions"),
    )


def compare_dates(metrics: DataFrame, first, second) -> DataFrame:
    """Entities new, removed or changed between two dates, matched on the lower-cased name."""
    keys = _QUESTION + ["section", "key"]
    at = lambda d, n: metrics.filter(F.col("date") == F.lit(d).cast("date")).groupBy(
        *_QUESTION, "section", F.lower("entity").alias("key")
    ).agg(F.max("entity").alias(f"entity{n}"), F.sum("mentions").alias(f"mentions{n}"))
    both = at(first, 1).join(at(second, 2), keys, "full_outer")
    change = F.col("mentions2") - F.col("mentions1")
    status = (
        F.when(F.col("entity1").isNull(), "new").when(F.col("entity2").isNull(), "removed")
        .when(change != 0, "changed")
    )
    return both.withColumn("status", status).filter(F.col("status").isNotNull()).select(
        *_QUESTION, "section", "status",
        F.coalesce("entity2", "entity1").alias("entity"),
        F.when(F.col("status") == "changed", change).alias("change"),
        F.when(F.col("status") == "changed", F.when(change > 0, "↑").otherwise("↓")).alias("arrow"),
    )


def compare_summary(comparison: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` rows per section and status, largest change first, with the number left out."""
    group = _QUESTION + ["section", "status"]
    sizes = comparison.groupBy(*group).agg(F.count(F.lit(1)).alias("in_group"))
    first = top_k(comparison, group, [F.desc(F.abs(F.coalesce("change", F.lit(0)))), F.col("entity")], k)
    return first.join(sizes, group).withColumn(
        "more", F.greatest(F.lit(0), F.col("in_group") - k).cast("long")
    ).drop("in_group")


def report_history(metrics: DataFrame, last_n: int | None = None) -> DataFrame:
    """Newest ``last_n`` report dates per project, counted by month."""
    dates = metrics.select("project", "date").distinct()
    if last_n is not None:
        dates = top_k(dates, ["project"], [F.desc("date")], last_n)
    return dates.groupBy("project", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("reports"), F.sort_array(F.collect_list("date")).alias("dates")
    )


def trend_by_regression(series: DataFrame, item: list[str]) -> DataFrame:
    """Trend code from a dated series (``item``…, date, value), by least squares over days.

    New or gone items come first; a flat slope is fluctuating when the residuals spread over more
    than a tenth of the mean.  Fewer than two values, or no newest value, is unknown.
    """
    value = F.col("value").cast("double")
    newest = series.groupBy(*item).agg(
        F.count(F.lit(1)).alias("points"),
        F.count("value").alias("valid"),
        F.max_by(F.struct(value.alias("v")), "date")["v"].alias("latest"),
        F.max("date").alias("last_date"),
    )
    days = F.unix_date("date").cast("double")
    fits = series.join(newest.select(*item, "last_date"), item).filter(F.col("value").isNotNull()).groupBy(
        *item
    ).agg(
        F.max(F.when(F.col("date") < F.col("last_date"), F.abs(value))).alias("before"),
        F.regr_slope(value, days).alias("slope"),
        F.regr_syy(value, days).alias("syy"),
        F.regr_sxy(value, days).alias("sxy"),
        F.avg(value).alias("mean"),
        F.countDistinct("date").alias("dates"),
    )
    # Residual sum of squares of the fitted line.
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("valid"))
    code = (
        F.when((F.col("points") < 2) | F.col("latest").isNull(), S.TREND_UNKNOWN)
        .when((F.col("latest") != 0) & (F.coalesce("before", F.lit(0.0)) == 0), S.TREND_NEW)
        .when((F.col("latest") == 0) & (F.coalesce("before", F.lit(0.0)) != 0), S.TREND_GONE)
        .when((F.col("valid") < 2) | (F.col("dates") < 2), S.TREND_UNKNOWN)
        .when(
            F.abs("slope") < SLOPE_STEADY,
            F.when(residual > F.col("mean") * RESIDUAL_SHARE, S.TREND_FLUCTUATING).otherwise(S.TREND_STABLE),
        )
        .when(F.col("slope") > 0, S.TREND_UP)
        .otherwise(S.TREND_DOWN)
    )
    return newest.join(fits, item, "left").select(*item, code.alias("trend"))


def cadence(metrics: DataFrame) -> DataFrame:
    """How often a project is measured, from its distinct dates against the days they span."""
    per_project = metrics.groupBy("project").agg(
        F.countDistinct("date").alias("points"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("day_span"),
    )
    points, span = F.col("points"), F.col("day_span")
    label = (
        F.when(points < 2, F.lit(None))
        .when(points >= span * 0.8, "Daily monitoring")
        .when(points >= span / 7 * 0.8, "Weekly monitoring")
        .when(points >= span / 14 * 0.8, "Bi-weekly monitoring")
        .when(points >= span / 30 * 0.8, "Monthly monitoring")
        .otherwise(F.concat(F.lit("Every ~"), F.round(span / points).cast("int").cast("string"), F.lit(" days")))
    )
    return per_project.select("project", points.alias("points"), span.cast("long").alias("day_span"), label.alias("cadence"))
