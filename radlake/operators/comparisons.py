"""Comparisons of structure sets: pairs of volumes, joins to both sides, and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_names(first: DataFrame, second: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, roi_name, first_voi, second_voi): volumes of equal name in two sets (voi_id, roi_name); of a name that repeats the last voi_id counts.

    key: columns that tell which sets are compared, on both sides.
    """
    by = [*(key or []), "roi_name"]
    last = lambda df, name: df.groupBy(*by).agg(F.max("voi_id").alias(name))
    return last(first, "first_voi").join(last(second, "second_voi"), by)


def zipped(requests: DataFrame, first: str, second: str) -> DataFrame:
    """Two arrays of ids of a request, place by place; blank places are left out, requests of unequal length have none."""
    pairs = F.explode(F.arrays_zip(F.col(first).alias("first_voi"), F.col(second).alias("second_voi")))
    rows = requests.filter(F.size(first) == F.size(second)).select(*[c for c in requests.columns if c not in (first, second)], pairs.alias("_p")).select("*", "_p.*").drop("_p")
    return rows.filter((F.coalesce("first_voi", F.lit("")) != "") & (F.coalesce("second_voi", F.lit("")) != ""))


def new_pairs(asked: DataFrame, known: DataFrame, a: str = "first_voi", b: str = "second_voi") -> DataFrame:
    """Asked pairs that exist in neither direction, each once: in the direction in which it was asked first (``place``)."""
    both = lambda df: df.withColumn("_low", F.least(a, b)).withColumn("_high", F.greatest(a, b))
    once = both(asked).groupBy("_low", "_high").agg(F.min_by(F.struct(a, b), "place").alias("_p"))
    return once.join(both(known).select("_low", "_high").distinct(), ["_low", "_high"], "left_anti").select(f"_p.{a}", f"_p.{b}")


def with_both_sides(comparisons: DataFrame, vois: DataFrame, sets: DataFrame) -> DataFrame:
    """Comparisons with first_ and second_ columns of the volume and of its structure set."""
    out = comparisons
    side = vois.join(sets, "rt_id")
    for n in ("first", "second"):
        out = out.join(side.select(F.col("voi_id").alias(f"{n}_voi"), *[F.col(c).alias(f"{n}_{c}") for c in side.columns if c != "voi_id"]), f"{n}_voi")
    return out


def of_series(both: DataFrame, series_uid: Column | str, column: str = "series_uid") -> DataFrame:
    """Comparisons either side of which refers to a series; null refers to none."""
    hit = lambda n: F.coalesce(F.col(f"{n}_{column}") == series_uid, F.lit(False))
    return both.filter(hit("first") | hit("second"))


def set_pairs(both: DataFrame) -> DataFrame:
    """(pair, labels, patient_id): pairs of structure sets, ids in order, labels as stored; both directions of a pair are two rows."""
    pair = F.concat_ws("-", F.least("first_rt_id", "second_rt_id"), F.greatest("first_rt_id", "second_rt_id"))
    return both.select(pair.alias("pair"), F.concat_ws(" ↔ ", "first_label", "second_label").alias("labels"), F.col("first_patient_id").alias("patient_id")).distinct()


def replaced(results: DataFrame, computed: DataFrame, key: str = "comparison_id") -> DataFrame:
    """Stored results with those of computed comparisons in place of their old ones; a metric that failed (null) is not stored."""
    return results.join(computed.select(key).distinct(), key, "left_anti").unionByName(computed.filter("value IS NOT NULL"))


#: Columns of the metrics table, as it is exported: header and column (fixed values).
METRIC_COLUMNS = [
    ("Metric ID", "metric_id"), ("Comparison ID", "comparison_id"), ("Metric Type", "metric"), ("Metric Value", "value"), ("Patient ID", "first_patient_id"), ("Patient Name", "first_patient_name"),
    ("Study Instance UID", "first_study_uid"), ("Series Instance UID (First)", "first_series_uid"), ("Series Instance UID (Second)", "second_series_uid"), ("First RT Structure Set Label", "first_label"),
    ("First RT Structure Set Name", "first_set_name"), ("First ROI Name", "first_roi_name"), ("First ROI Number", "first_roi_number"), ("Second RT Structure Set Label", "second_label"),
    ("Second RT Structure Set Name", "second_set_name"), ("Second ROI Name", "second_roi_name"), ("Second ROI Number", "second_roi_number"), ("Comparison Created At", "comparison_created"),
    ("Metric Created At", "created"), ("Computed By User", "user"),
]


def metrics_export(results: DataFrame, both: DataFrame) -> DataFrame:
    """The 20 columns of the metrics table; what is missing, empty or 0 is N/A. Nothing is ordered: sort by ``Metric Created At`` when writing."""
    joined = results.join(both, "comparison_id")
    kept = {"metric_id", "comparison_id", "metric", "value"}

    def shown(column: str) -> Column:
        if column not in joined.columns:
            return F.lit("N/A")
        text = F.date_format(column, "yyyy-MM-dd HH:mm:ss") if dict(joined.dtypes)[column].startswith("timestamp") else F.col(column).cast("string")
        return text if column in kept else F.when(F.coalesce(text, F.lit("")).isin("", "0"), "N/A").otherwise(text)

    return joined.select(*[shown(c).alias(h) for h, c in METRIC_COLUMNS])


def latest_metrics(results: DataFrame, metric: str | None = None, most: int = 1000) -> DataFrame:
    """The newest results, of one metric if it is given."""
    rows = results.filter(F.col("metric") == metric) if metric else results
    return rows.orderBy(F.col("created").desc(), "metric_id").limit(most)
