"""Catalog ingest, joins and window-shaped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MODALITIES = ("CT", "MR", "PT")
LOCALIZER = r"(?i)\b(topogram|scout|scanogram|surview)\b"


def skip_reason(files: DataFrame, as_of: Column, date_filter: Column, study_filter: Column, modalities: tuple[str, ...] = MODALITIES, exclude_localizers: bool = True) -> DataFrame:
    """Adds reason: the first rule that drops a file, or null.

    files: mtime, modality, sop_uid, series_description, study_date (yyyymmdd
    text). A study date that can't be read keeps the file.
    """
    day = F.when(F.col("study_date").rlike(r"^\d{8}$"), F.try_to_timestamp("study_date", F.lit("yyyyMMdd")))
    reason = (
        F.when(F.col("mtime") > as_of - F.expr("INTERVAL 10 MINUTES"), "recently_modified")
        .when((date_filter <= as_of) & (F.col("mtime") < date_filter), "before_date_filter")
        .when(~F.coalesce(F.col("modality").isin(*modalities), F.lit(False)), "modality")
        .when(F.coalesce(F.col("sop_uid"), F.lit("")) == "", "missing_sop_uid")
        .when(F.lit(exclude_localizers) & F.coalesce(F.col("series_description").rlike(LOCALIZER), F.lit(False)), "localizer_series")
        .when(F.coalesce(day < study_filter, F.lit(False)), "study_date_before_filter")
    )
    return files.withColumn("reason", reason)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in a total order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def latest(df: DataFrame, key: str, by: list[str], columns: list[str]) -> DataFrame:
    """Columns of the row with the largest ``by`` of each key, without a window."""
    got = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("_m"))
    return got.select(key, "_m.*")


def new_rows(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet."""
    return incoming.join(known.select(*keys).distinct(), keys, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], update: bool = False) -> DataFrame:
    """Insert if the key is absent; else keep the row, or take the incoming one."""
    kept, added = (current, incoming.join(current.select(*keys), keys, "left_anti")) if not update else (current.join(incoming.select(*keys), keys, "left_anti"), incoming)
    return kept.unionByName(added)


def change_runs(events: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """(by, value, run, n, first, last): a new value of the same source closes the run before."""
    w = W.partitionBy(by).orderBy(*order)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    numbered = events.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w))
    return numbered.groupBy(by, value, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def until_freed(files: DataFrame, size: str, order: list[str], target: float, part: str | None = None, cutoff: Column | None = None) -> DataFrame:
    """Oldest files first, until what they free reaches the target; adds freed.

    part: a separate target for each; else there is one for all. cutoff: only
    files whose order[0] is before it. Without part, order[0] is a time or a
    number: its ranges are summed apart, the sums of the ranges before are
    added, and ranges behind the target are left out.
    """
    if cutoff is not None:
        files = files.filter(F.col(order[0]) < cutoff)
    if part:
        freed = files.withColumn("freed", F.sum(size).over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
        return freed.filter(F.col("freed") - F.col(size) < target)
    at = F.col(order[0])
    if dict(files.dtypes)[order[0]] == "timestamp_ntz":  # by its fields: a zone with summer time would turn hours round
        at = F.unix_date(at.cast("date")) * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    at = at.cast("double")
    bounds = sorted(set(files.select(at.alias("at")).approxQuantile("at", [k / 64 for k in range(1, 64)], 0.005)))
    ranged = files.withColumn("_range", sum([F.coalesce((at > x).cast("int"), F.lit(0)) for x in bounds], F.lit(0)))
    before, total = [], 0
    for r in ranged.groupBy("_range").agg(F.sum(size).alias("n")).orderBy("_range").collect():
        if total < target:
            before.append((r["_range"], total))
        total += r.n or 0
    if not before:
        return files.withColumn("freed", F.sum(size).over(W.partitionBy(*order))).limit(0)
    base = F.create_map(*[F.lit(x) for pair in before for x in pair])[F.col("_range")]
    w = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    freed = ranged.filter(F.col("_range").isin([x for x, _ in before])).withColumn("freed", base + F.sum(size).over(w)).drop("_range")
    return freed.filter(F.col("freed") - F.col(size) < target)


def symmetric_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs."""
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


#: Characters of the longest grams of the index.
GRAM = 3


def _grams(text: Column, q: Column) -> Column:
    """The different runs of q characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - q + 1), lambda i: F.substring(text, i, q)))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(x, y): every text x of inner with every text y of outer that holds it; texts are not empty.

    By an index of grams: of x the gram that the fewest texts of outer have
    selects those that are compared. A text shorter than a gram is a gram.
    """
    indexed = outer.select("y").distinct().withColumn("_q", F.explode(F.sequence(F.lit(1), F.least(F.char_length("y"), F.lit(GRAM)))))
    indexed = indexed.select("y", F.explode(_grams(F.col("y"), F.col("_q"))).alias("_gram"))
    counts = indexed.groupBy("_gram").agg(F.count("*").alias("_n"))
    own = inner.select("x").distinct().select("x", F.explode(_grams(F.col("x"), F.least(F.char_length("x"), F.lit(GRAM)))).alias("_gram"))
    rarest = own.join(counts, "_gram", "left").groupBy("x").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return rarest.join(indexed, "_gram").filter(F.col("y").contains(F.col("x"))).select("x", "y")


def tiered_match(names: DataFrame, templates: DataFrame) -> DataFrame:
    """(name, template, tier): the best template of each name.

    Tiers: equal without case, spaces as _, without separators, one inside the
    other without case. The first three are equi joins on normalised names, in
    which the last of several equal templates counts; what is left meets the
    templates through an index of grams, in the order in which their names first
    appear. The empty text is inside every other one.
    """
    forms = [F.lower, lambda c: F.regexp_replace(F.lower(c), " ", "_"), lambda c: F.regexp_replace(F.lower(c), "[ _-]", "")]
    t = templates.select(F.col("name").alias("template"), "position")
    found, left = None, names.select("name").distinct()
    for tier, form in enumerate(forms, 1):
        last = t.groupBy(form(F.col("template")).alias("_form")).agg(F.max_by("template", "position").alias("template"))
        hit = left.join(last, form(F.col("name")) == F.col("_form")).select("name", "template", F.lit(tier).alias("tier"))
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit, "name", "left_anti")
    left = left.filter("name IS NOT NULL").withColumn("_low", F.lower("name"))
    known = t.filter("template IS NOT NULL").groupBy(F.lower("template").alias("_form")).agg(F.max_by("template", "position").alias("template"), F.min("position").alias("position"))
    low, form = left.filter("_low <> ''").select("_low").distinct(), known.filter("_form <> ''").select("_form")
    pairs = contained(form.withColumnRenamed("_form", "x"), low.withColumnRenamed("_low", "y")).select(F.col("x").alias("_form"), F.col("y").alias("_low"))
    pairs = pairs.union(contained(low.withColumnRenamed("_low", "x"), form.withColumnRenamed("_form", "y")).select(F.col("y").alias("_form"), F.col("x").alias("_low")))
    hits = left.join(pairs, "_low").join(known, "_form").select("name", "template", "position")
    none = known.filter("_form = ''").select("template", "position")  # one row at the most, for every name
    first = known.agg(F.min_by("template", "position").alias("template"), F.min("position").alias("position"))  # one row, for the empty name
    hits = hits.union(left.select("name").crossJoin(F.broadcast(none))).union(left.filter("_low = ''").select("name").crossJoin(F.broadcast(first)))
    best = hits.filter("position IS NOT NULL").groupBy("name").agg(F.min_by("template", "position").alias("template"))
    return found.unionByName(best.withColumn("tier", F.lit(4)))


def remap(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Values through a (uid_from, uid_to) table; what is not mapped passes through."""
    for c in columns:
        m = mapping.select(F.col("uid_from").alias("_f"), F.col("uid_to").alias("_t"))
        rows = rows.join(m, F.col(c) == F.col("_f"), "left").withColumn(c, F.coalesce("_t", c)).drop("_f", "_t")
    return rows


def unique_properties(structures: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Properties by name; a name that occurs twice is ambiguous and has none."""
    one = F.count("*") == 1
    return structures.groupBy(name).agg(*[F.when(one, F.first(c)).alias(c) for c in columns], (~one).alias("ambiguous"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of an ordered list."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def finalised(files: DataFrame) -> DataFrame:
    """(series_uid, directory, n, n_dropped): the directory in which each series is met first (by place), its files there, and those elsewhere, which are not taken."""
    first = files.groupBy("series_uid").agg(F.min_by("directory", "place").alias("_first"))
    here = F.col("directory") == F.col("_first")
    counted = files.join(first, "series_uid").groupBy("series_uid", F.col("_first")).agg(F.count_if(here).alias("n"), F.count_if(~here).alias("n_dropped"))
    return counted.select("series_uid", F.col("_first").alias("directory"), "n", "n_dropped")


def next_start(start: Column, as_of: Column, succeeded: Column, days: int = 7) -> Column:
    """Where the next run begins: so many days before one that succeeded."""
    return F.when(succeeded, as_of - F.make_interval(days=F.lit(days))).otherwise(start)


def resume_after(directories: DataFrame, last: str | None, saved: Column, as_of: Column, hours: int = 4) -> DataFrame:
    """Directories behind the last one of a run that was broken off, if its mark is not older than so many hours; else all."""
    if last is None:
        return directories
    return directories.filter((F.col("directory") > last) | (saved < as_of - F.make_interval(hours=F.lit(hours))))
