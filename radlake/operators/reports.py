"""Reporting: conditional counts, roll-ups, medians, nested documents and exports."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scratch import saved


def counts_since(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row of counts, all in one pass."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def to_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(parameter_name, parameter_value) rows of one wide row."""
    return df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))).alias("parameter_name", "parameter_value"))


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def counts_per(parents: DataFrame, children: DataFrame, key: str, child: str, name: str) -> DataFrame:
    """Children of each parent, with zero for those without."""
    n = children.groupBy(key).agg(F.count_distinct(child).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def mean_over_all(cases: DataFrame, seconds: Column) -> DataFrame:
    """(total_seconds, cases, mean_seconds): pairs that are missing count as zero."""
    total = F.coalesce(F.sum(seconds), F.lit(0.0))
    return cases.agg(total.alias("total_seconds"), F.count("*").alias("cases"), F.try_divide(total, F.count("*")).alias("mean_seconds"))


def digit_sums(stats: DataFrame, value: str, windows: dict[str, Column], by: str) -> DataFrame:
    """Per parameter the sum of values made of digits only, in each window."""
    number = F.when(F.col(value).rlike("^[0-9]+$"), F.col(value).try_cast("long"))
    return stats.groupBy(by).agg(*[F.coalesce(F.sum(F.when(test, number)), F.lit(0)).alias(name) for name, test in windows.items()])


def summary_rollup(series: DataFrame) -> DataFrame:
    """Series and instances per study, per patient and in all, in one pass."""
    out = series.rollup("patient_id", "study_uid").agg(F.count("*").alias("n_series"), F.sum("instance_count").alias("n_instances"), F.grouping_id().alias("level"))
    return out


def nested(patients: DataFrame, studies: DataFrame, series: DataFrame) -> DataFrame:
    """(patient_id, document): patient -> studies -> series, each level ordered, as JSON."""
    per_study = series.groupBy("study_uid").agg(F.array_sort(F.collect_list(F.struct("series_uid", "instance_count"))).alias("series"))
    with_series = studies.join(per_study, "study_uid", "left")
    per_patient = with_series.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("study_uid", "study_date", "series"))).alias("studies"))
    return patients.join(per_patient, "patient_id", "left").select("patient_id", F.to_json(F.struct("patient_id", "patient_name", "studies")).alias("document"))


def storage_usage(files: DataFrame, size: str, limit: float) -> DataFrame:
    """(n_files, used, percent, available)."""
    used = F.coalesce(F.sum(size), F.lit(0.0))
    return files.agg(F.count("*").alias("n_files"), used.alias("used"), F.when(F.lit(limit) > 0, used * 100 / limit).otherwise(0.0).alias("percent"), F.greatest(F.lit(0.0), F.lit(limit) - used).alias("available"))


def counters(tables: dict[str, DataFrame], since: Column, tests: dict[str, tuple[str, Column | None, str]]) -> DataFrame:
    """(parameter_name, parameter_value) of counts since the last run, one pass over each table.

    tests: name -> (table, condition or None, its time column), null conditions
    don't count. A table is read once for all its counters.
    """
    out = None
    for table in dict.fromkeys(t for t, _, _ in tests.values()):
        mine = {n: (c, at) for n, (t, c, at) in tests.items() if t == table}
        one = tables[table].agg(*[F.count_if((F.col(at) > since) & (F.lit(True) if c is None else F.coalesce(c, F.lit(False)))).alias(n) for n, (c, at) in mine.items()])
        rows = to_long(one, list(mine))
        out = rows if out is None else out.union(rows)
    return out


def buckets(df: DataFrame, status: str, groups: dict[str, list[str]]) -> DataFrame:
    """One row: the rows in all, and those whose status is in each group."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status).isin(values)).alias(name) for name, values in groups.items()])


def choices(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that are not empty, each once, in order."""
    return df.select(column).filter(F.coalesce(column, F.lit("")) != "").distinct().orderBy(column)


def structure_counts(series: DataFrame, structures: DataFrame) -> DataFrame:
    """Structure sets and rated ones of each series, with zero for those without."""
    n = structures.groupBy("series_uid").agg(F.count("*").alias("n_structures"), F.count("reviewed").alias("n_rated"))
    return series.join(n, "series_uid", "left").fillna(0, ["n_structures", "n_rated"])


def has_rating() -> Column:
    """Whether a structure set has a date, a time or a rating of a review."""
    return F.col("reviewed").isNotNull() | F.col("minutes").isNotNull() | F.col("rating").isNotNull()


def patient_documents(patients: DataFrame, studies: DataFrame, series: DataFrame, structures: DataFrame, vois: DataFrame) -> DataFrame:
    """(patient_id, document): patient -> studies -> series -> structure sets -> volumes, as JSON, each level in the order of its key."""
    levels = lambda df, key, name, *columns: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    per_set = levels(vois, "rt_id", "vois", "volume_name")
    sets = structures.join(per_set, "rt_id", "left").withColumns({"voi_count": F.coalesce(F.size("vois"), F.lit(0)), "has_rating": has_rating()})
    sets = sets.withColumn("voi_count", F.greatest("voi_count", F.lit(0)))
    per_series = levels(sets.filter("series_uid IS NOT NULL"), "series_uid", "structures", "rt_id", "voi_count", "has_rating", "vois")
    per_study = levels(series.join(per_series, "series_uid", "left"), "study_uid", "series", "series_uid", "instance_count", "structures")
    per_patient = levels(studies.join(per_study, "study_uid", "left"), "patient_id", "studies", "study_uid", "series")
    return patients.join(per_patient, "patient_id", "left").select("patient_id", F.to_json(F.struct("patient_id", "patient_name", "studies")).alias("document"))


#: Columns of the ratings table, as it is exported (fixed values).
RATING_COLUMNS = [
    "patient_id", "name", "gender", "date_of_birth", "series_instance_uid", "date_contour_reviewed", "contour_modification_time_required", "assessor_name", "overall_rating",
    "volume_name", "contour_modification", "contour_modification_type", "contour_modification_comments",
]


def ratings_export(structures: DataFrame, vois: DataFrame, series: DataFrame) -> DataFrame:
    """One row for each volume of a reviewed structure set, one for a set without volumes; the 13 columns, empty where there is nothing.

    series: series_uid with the patient's columns; sets without a series are left out.
    """
    rows = structures.filter("reviewed IS NOT NULL").join(series, "series_uid").join(vois, "rt_id", "left")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    plain = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit("")
    number = lambda c: F.nullif(plain(c), F.lit("0"))
    values = [
        plain("patient_id"), plain("patient_name"), plain("gender"), day("birth_date") if "birth_date" in rows.columns else F.lit(""), plain("series_uid"), day("reviewed"), number("minutes"), plain("assessor"),
        number("rating"), plain("volume_name"), plain("modification"), F.array_join("modification_types", ", "), plain("comments"),
    ]
    return rows.select(*[F.coalesce(v, F.lit("")).alias(n) for n, v in zip(RATING_COLUMNS, values)])


def template_documents(templates: DataFrame, models: DataFrame, structures: DataFrame) -> DataFrame:
    """(template_id, document): a template as nested JSON, which is YAML as well: name, protocol and its models with their maps.

    models: template_id, model_id, name, config, trainer_name, postprocess;
    structures: model_id, map_id, name. Of a map_id that repeats in a model the
    last name counts.
    """
    of_model = structures.groupBy("model_id", "map_id").agg(F.max("name").alias("name")).groupBy("model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("map_id", "name")))).alias("map"))
    body = F.struct("name", "config", F.coalesce("map", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("map"), "trainer_name", "postprocess")
    rows = models.join(of_model.withColumn("map", F.transform_keys("map", lambda k, v: k.cast("string"))), "model_id", "left").withColumn("_body", body)
    by_id = lambda a, b: F.when(a["model_id"] < b["model_id"], -1).when(a["model_id"] > b["model_id"], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(F.col("model_id").cast("string").alias("model_id"), "_body")), by_id)
    of_template = rows.groupBy("template_id").agg(F.map_from_entries(entries).alias("models"))
    out = templates.join(of_template, "template_id", "left")
    return out.select("template_id", F.to_json(F.struct(F.col("template_name").alias("name"), F.lit("DRAW").alias("protocol"), "models")).alias("document"))


def hierarchy_counts(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents with the number of their children and of these's children, counted apart, with zero for those without."""
    n = grandchildren.groupBy(child).agg(F.count("*").alias("_g"))
    both = children.join(n, child, "left").groupBy(parent).agg(F.count("*").alias("n_children"), F.coalesce(F.sum("_g"), F.lit(0)).alias("n_grandchildren"))
    return parents.join(both, parent, "left").fillna(0, ["n_children", "n_grandchildren"])


def tail(lines: DataFrame, by: str, number: str, n: int) -> DataFrame:
    """The last n lines of each file."""
    return lines.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(F.col(number).desc()))).filter(F.col("_k") <= n).drop("_k")


def slice_order(slices: DataFrame) -> DataFrame:
    """Adds slice_index from 0: by instance number, location and z (0 if missing), then by path."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    order = W.partitionBy("series_uid").orderBy(zero("instance_number"), zero("slice_location"), zero("z"), "path")
    return slices.withColumn("slice_index", F.row_number().over(order) - 1)


#: Buckets of a histogram of medians(), and rows that are few enough to be sorted.
BUCKETS, FEW = 1024, 2048


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the exact median of each group, as median() gives it, without one task that holds a group.

    A histogram between the least and the largest value tells in which bucket the
    middle lies; only this bucket is looked at again, between its own least and
    largest value, until it has few rows or one value. Nulls are left out, NaN is
    larger than all numbers; a group without values has null.
    """
    kept = rows.select(F.struct(*by).alias("key"), F.col(value).cast("double").alias("v"))
    real = kept.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = kept.groupBy("key").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("c"), F.min(F.when(~F.isnan("v"), F.col("v"))).alias("lo"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("hi"))
    counts = saved(counts, "medians")
    middle = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.floor((F.col("n") - 1 + k) / 2).alias("rank")) for k in (0, 1)])).alias("m")
    state = counts.filter("n > 0").select("key", middle, "c", "lo", "hi").select("key", "m.which", "m.rank", "c", "lo", "hi")
    nan = state.filter("rank >= c").select("key", "which", F.lit(float("nan")).alias("v"))
    open_ = state.filter("rank < c")
    done = [nan]
    while True:
        done.append(open_.filter("lo = hi").select("key", "which", F.col("lo").alias("v")))
        few = open_.filter((F.col("lo") < F.col("hi")) & (F.col("c") <= FEW))
        met = real.join(few, "key").filter("v >= lo AND v <= hi")
        order = F.row_number().over(W.partitionBy("key", "which").orderBy("v"))  # few rows
        done.append(met.withColumn("_k", order).filter("_k = rank + 1").select("key", "which", "v"))
        many = open_.filter((F.col("lo") < F.col("hi")) & (F.col("c") > FEW))
        if many.isEmpty():
            break
        # halves of finite numbers, as the distance of two doubles need not be one; where it is 0, the least value has a bucket of its own
        half = lambda c: F.greatest(F.least(F.col(c), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)) / 2
        width = half("hi") - half("lo")
        bucket = F.when(width > 0, F.least(F.floor((half("v") - half("lo")) / width * BUCKETS), F.lit(BUCKETS - 1))).otherwise((F.col("v") > F.col("lo")).cast("long")).alias("bucket")
        inside = real.join(many, "key").filter("v >= lo AND v <= hi")
        histogram = inside.groupBy("key", "which", "rank", bucket).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("c").over(W.partitionBy("key", "which").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # BUCKETS rows at the most
        here = histogram.withColumn("_b", before).filter("_b <= rank AND rank < _b + c")
        open_ = saved(here.select("key", "which", (F.col("rank") - F.col("_b")).alias("rank"), "c", "lo", "hi"), "medians")
    middle = F.when(F.abs(F.sum("v")) == float("inf"), F.sum(F.col("v") / 2)).otherwise(F.sum("v") / 2)  # a sum may be too large
    values = reduce(lambda a, b: a.union(b), done).groupBy("key").agg(middle.alias("median"))
    out = counts.select("key").join(values, "key", "left")
    return out.select(*[F.col(f"key.{c}").alias(c) for c in by], "median")
