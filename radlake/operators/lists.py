"""List filters, constraint checks, state changes and batch gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vr as VR
from ..functions.scalar import average_mb, dicom_date, mask, or_default, short_label, uptime


def search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows with the text in any of the columns, without regard to case; an empty text finds all."""
    if not needle:
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in columns]))


def optional(df: DataFrame, equal: dict[str, object], between: dict[str, tuple]) -> DataFrame:
    """Equality and range filters; those without a value are left out."""
    for c, v in equal.items():
        if v not in (None, ""):
            df = df.filter(F.col(c) == v)
    for c, (low, high) in between.items():
        df = df.filter(F.col(c) >= low) if low is not None else df
        df = df.filter(F.col(c) <= high) if high is not None else df
    return df


def to_poll(exports: DataFrame, as_of: Column, done: list[str], days: int = 7) -> DataFrame:
    """Completed transfers whose server status is not final; a missing status stays; stale unknown tasks go."""
    waiting = F.coalesce(~F.col("server_status").isin(done), F.lit(True))
    stale = F.coalesce((F.col("server_status") == "TASK_NOT_FOUND") & (F.col("transfer_time") < as_of - F.make_interval(days=F.lit(days))), F.lit(False))
    return exports.filter((F.col("transfer_status") == "COMPLETED") & waiting & ~stale)


def allowed(requests: DataFrame, titles: DataFrame, networks: list[str]) -> DataFrame:
    """Requests of known, active titles whose address holds one of the networks, or begins with its part before the / (no networks: any)."""
    known = requests.join(titles.filter("is_active").select("ae_title"), "ae_title", "left_semi")
    tests = [F.col("ip").contains(n.strip()) | F.col("ip").startswith(n.strip().split("/")[0]) for n in networks]
    return known.filter(reduce(lambda a, b: a | b, tests)) if networks else known


def gate(batch: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All rows if no check fails for any, else none: the errors of the batch are one row that joins every row."""
    errors = batch.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    clean = errors.filter(reduce(lambda a, b: a & b, [F.col(n) == 0 for n in checks])).select(F.lit(True).alias("_ok"))
    return batch.join(clean, F.lit(True), "left_semi")


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """Per key the destination that takes it: primary ones first, then by priority; the first success."""
    order = W.partitionBy(key).orderBy(F.col("is_primary").desc(), "priority", "destination")
    ranked = attempts.withColumn("attempt", F.row_number().over(order))
    return ranked.filter("success").groupBy(key).agg(F.min_by(F.struct("destination", "attempt"), "attempt").alias("_d")).select(key, "_d.*")


#: Which status may follow which (fixed values).
TRANSITIONS = {
    "UNPROCESSED": ["RULE_NOT_MATCHED", "RULE_MATCHED", "MULTIPLE_RULES_MATCHED"], "RULE_MATCHED": ["DEIDENTIFIED_SUCCESSFULLY", "DEIDENTIFICATION_FAILED"],
    "MULTIPLE_RULES_MATCHED": ["DEIDENTIFIED_SUCCESSFULLY", "DEIDENTIFICATION_FAILED"], "DEIDENTIFIED_SUCCESSFULLY": ["PENDING_TRANSFER_TO_DRAW_SERVER"],
    "PENDING_TRANSFER_TO_DRAW_SERVER": ["SENT_TO_DRAW_SERVER", "FAILED_TRANSFER_TO_DRAW_SERVER"], "SENT_TO_DRAW_SERVER": ["RTSTRUCTURE_RECEIVED", "INVALID_RTSTRUCTURE_RECEIVED"],
    "RTSTRUCTURE_RECEIVED": ["RTSTRUCTURE_EXPORTED", "RTSTRUCTURE_EXPORT_FAILED"],
}


def next_status(status: Column, wanted: Column) -> Column:
    """The wanted status if it may follow, else the one there is."""
    out = F.lit(False)
    for source, targets in TRANSITIONS.items():
        out = out | ((status == source) & wanted.isin(targets))
    return F.when(out, wanted).otherwise(status)


def job_status(total: Column, done: Column, failed: Column) -> Column:
    """How a retrieval ended: partial if some failed and not all are there."""
    return F.when((failed > 0) & (done < total), "partial").otherwise("completed")


def rule_error(vr: Column, operator: Column, value: Column) -> Column:
    """Why a rule can't be saved; null if it can."""
    numeric = value.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    typed = F.when(~VR.valid(value, vr), "value").when(~F.array_contains(VR.operators(vr), operator), "operator")
    plain = F.when(~operator.contains("STRING") & ~numeric, "value")
    return F.when(F.coalesce(vr, F.lit("")) == "", plain).otherwise(typed)


def mapping_changes(current: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): created, updated, same or removed."""
    a, b = current.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), wanted.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "created").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("updated")
    return a.join(b, key, "full").select(key, change.alias("change"))


def _flags(tests: dict[str, Column]) -> Column:
    """Names of the tests that are true, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def destination_errors(nodes: DataFrame) -> DataFrame:
    """(node, error): what is wrong with export destinations; nodes: node, is_export, is_primary, is_fallback, priority.

    Only one node may be a destination; a primary or fallback must be one, but
    not both; a fallback needs a primary and a priority of its own; others have
    no priority. The counts over all nodes come as one row.
    """
    whole = nodes.agg(F.count_if("is_export").alias("_exports"), F.count_if("is_primary").alias("_primaries"))
    shared = nodes.filter("is_fallback AND priority IS NOT NULL").groupBy("priority").agg(F.count("*").alias("_n"))
    joined = nodes.join(shared, "priority", "left").crossJoin(whole)  # one row on the right
    tests = {
        "another_destination": F.col("is_export") & (F.col("_exports") > 1), "not_a_destination": (F.col("is_primary") | F.col("is_fallback")) & ~F.col("is_export"),
        "primary_and_fallback": F.col("is_primary") & F.col("is_fallback"), "no_primary": F.col("is_fallback") & (F.col("_primaries") - F.col("is_primary").cast("int") < 1),
        "no_priority": F.col("is_fallback") & F.col("priority").isNull(), "priority_without_fallback": ~F.col("is_fallback") & F.col("priority").isNotNull(), "priority_taken": F.col("is_fallback") & (F.col("_n") > 1),
    }
    return joined.select("node", F.explode(_flags(tests)).alias("error"))


def node_kind(incoming: Column, outgoing: list[Column]) -> Column:
    out = reduce(lambda a, b: a | b, outgoing)
    return F.when(incoming & out, "bidirectional").when(incoming, "incoming").when(out, "outgoing").otherwise("unconfigured")


def capabilities(incoming: Column, find: Column, move: Column, get: Column) -> Column:
    """What a node can do, in words."""
    words = F.array_join(_flags({"C-STORE (receive)": incoming, "C-FIND": find, "C-MOVE": move, "C-GET": get}), ", ")
    return F.when(words == "", "No capabilities configured").otherwise(words)


def server_errors(configs: DataFrame, services: list[str], syntaxes: list[str]) -> DataFrame:
    """(config, error): titles over 16 characters, addresses that are none, no service, no transfer syntax."""
    address = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(/\d{1,2})?$"
    bad = F.exists(F.split("allowed_ips", ","), lambda x: ~F.trim(x).rlike(address))
    none = lambda columns: ~reduce(lambda a, b: a | b, [F.col(c) for c in columns])
    tests = {"title": F.char_length("ae_title") > 16, "address": F.col("check_ips") & (F.coalesce("allowed_ips", F.lit("")) != "") & bad, "service": none(services), "syntax": none(syntaxes)}
    return configs.select("config", F.explode(_flags(tests)).alias("error"))


def missing_tags(tags: Column, required: list[str]) -> Column:
    """Required tags that are null or not there, in order."""
    return _flags({k: F.try_element_at(tags, F.lit(k)).isNull() for k in required})


#: What a received image must have; a series that is registered needs a modality, too (fixed values).
REQUIRED = ["PatientID", "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID"]


def taken_labels(wanted: DataFrame, added: DataFrame, properties: DataFrame, structures: DataFrame) -> DataFrame:
    """Wanted labels (template, label) that a template has already, without regard to case: (template, label, source).

    Sources: added structures, labels of mapped ones, names of structures; each
    a table (template, label).
    """
    every = None
    for name, df in (("additional", added), ("property", properties), ("structure", structures)):
        rows = df.filter(F.coalesce("label", F.lit("")) != "").select("template", F.lower("label").alias("_l"), F.lit(name).alias("source"))
        every = rows if every is None else every.unionByName(rows)
    asked = wanted.withColumn("_l", F.lower("label"))
    return asked.join(every.groupBy("template", "_l").agg(F.min("source").alias("source")), ["template", "_l"]).drop("_l")


def selection_errors(asked: DataFrame, series: DataFrame, templates: DataFrame, models: DataFrame, structures: DataFrame, instances: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds error to (series_uid, template_id): the first thing wrong with a manual selection, or null.

    Missing ids, unknown series, unknown template, a template without models or
    with a model without structures, a series without images or with a file that
    is not there. With gate(), any error empties the whole selection.
    """
    n = structures.groupBy("model_id").agg(F.count("*").alias("_structures"))
    of_template = models.join(n, "model_id", "left").groupBy("template_id").agg(F.count("*").alias("_models"), F.min(F.coalesce("_structures", F.lit(0))).alias("_least"))
    there = existing.select("path", F.lit(1).alias("_there")).distinct()
    files = instances.join(there, "path", "left").groupBy("series_uid").agg(F.count("*").alias("_files"), F.count("_there").alias("_found"))
    out = asked.join(series.select("series_uid", F.lit(True).alias("_series")).distinct(), "series_uid", "left").join(templates.select("template_id", F.lit(True).alias("_template")).distinct(), "template_id", "left")
    out = out.join(of_template, "template_id", "left").join(files, "series_uid", "left")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    error = (
        F.when(empty("series_uid"), "no_series_uid").when(empty("template_id"), "no_template_id").when(F.col("_series").isNull(), "unknown_series").when(F.col("_template").isNull(), "unknown_template")
        .when(F.col("_models").isNull(), "no_models").when(F.col("_least") == 0, "no_structures").when(F.col("_files").isNull(), "no_instances").when(F.col("_found") < F.col("_files"), "missing_files")
    )
    return out.select(*asked.columns, error.alias("error"))


def violations(nodes: DataFrame) -> DataFrame:
    """(rule, node): nodes against the rules of export destinations, and priorities that are not unique."""
    both = nodes.filter("is_primary AND is_fallback").select(F.lit("primary_and_fallback").alias("rule"), "node")
    twice = nodes.filter("is_fallback").withColumn("_n", F.count("*").over(W.partitionBy("priority"))).filter("_n > 1").select(F.lit("priority").alias("rule"), "node")
    return both.union(twice)


def accepted(files: DataFrame) -> DataFrame:
    """Adds reason: why a returned structure set is refused, or null. The checksum is tested first; a missing reference or checksum is accepted."""
    reason = (
        F.when((F.coalesce("header_checksum", F.lit("")) != "") & (F.col("header_checksum") != F.col("checksum")), "checksum").when(~F.col("readable"), "unreadable")
        .when(F.coalesce(F.col("modality"), F.lit("")) != "RTSTRUCT", "modality").when(F.col("referenced_series") != F.col("expected_series"), "series")
    )
    return files.withColumn("reason", reason)


def append_numbered(rows: DataFrame, added: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """Added rows numbered from the largest number of their key on."""
    top = rows.groupBy(key).agg(F.max(number).alias("_top"))
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    return added.join(top, key, "left").withColumn(number, F.coalesce("_top", F.lit(0)) + n).drop("_top")


def windowed(value: Column, centre: float, width: float, slope: float = 1.0, intercept: float = 0.0) -> Column:
    """Rescaled and windowed to 0..255."""
    low = centre - width / 2
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), (value * slope + intercept - low) / width * 255))


def cancelled(status: Column) -> Column:
    """The status after a cancel: what has been sent, received or exported stays."""
    return F.when(status.isin("SENT_TO_DRAW_SERVER", "RTSTRUCTURE_RECEIVED", "RTSTRUCTURE_EXPORTED"), status).otherwise("UNPROCESSED")


def captured(answers: DataFrame, tags: str = "tags") -> DataFrame:
    """Answers to a remote query as rows: text fields, the date and number where they can be read, and the whole as JSON."""
    get = lambda k: F.try_element_at(F.col(tags), F.lit(k))
    text = {"patient_id": "PatientID", "patient_name": "PatientName", "study_uid": "StudyInstanceUID", "series_uid": "SeriesInstanceUID", "modality": "Modality", "study_description": "StudyDescription", "series_description": "SeriesDescription"}
    number = F.coalesce(F.nullif(get("NumberOfSeriesRelatedInstances"), F.lit("")), get("NumberOfStudyRelatedInstances"))
    out = {c: F.coalesce(get(k), F.lit("")) for c, k in text.items()} | {"study_date": dicom_date(get("StudyDate")), "number_of_instances": F.trim(number).try_cast("int"), "result": F.to_json(tags)}
    return answers.withColumns(out)


def unmapped_structures(structures: DataFrame, mapped: DataFrame) -> DataFrame:
    """Template structures (id, name) that nothing is mapped to, with a short name for the preview."""
    return structures.join(mapped.select("id").distinct(), "id", "left_anti").withColumn("short_name", short_label(F.col("name")))


def label_errors(chosen: DataFrame) -> DataFrame:
    """Adds error to (template, name, label): required, too long, or the same as an earlier one (by ``place``) without regard to case."""
    label = F.trim("label")
    bad = F.when(F.coalesce(label, F.lit("")) == "", "required").when(F.char_length(label) > 16, "length")
    marked = chosen.withColumn("_bad", bad)
    nth = F.row_number().over(W.partitionBy("template", F.col("_bad").isNull(), F.lower(label)).orderBy("place"))
    return marked.withColumn("error", F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(nth > 1, "duplicate")).drop("_bad")


def rated(imports: DataFrame, vois: DataFrame, ratings: DataFrame, user: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Imports and volumes after ratings are stored; the assessor is the user and the date is as_of, whatever was sent.

    ratings: series_uid, minutes, rating, volumes (array of volume_name,
    modification, types, comments). The first import of a series (by created,
    rt_id) takes the rating; a volume replaces the one of its name, its types
    are replaced as a whole.
    """
    first = imports.join(ratings, "series_uid").groupBy("series_uid").agg(F.min_by("rt_id", F.struct("created", "rt_id")).alias("rt_id"))
    given = ratings.join(first, "series_uid").select("rt_id", F.col("minutes").alias("_m"), F.col("rating").alias("_r"), "volumes")
    hit = F.col("volumes").isNotNull()
    out = imports.join(given, "rt_id", "left").withColumns({
        "minutes": F.when(hit, F.col("_m")).otherwise(F.col("minutes")), "rating": F.when(hit, F.col("_r")).otherwise(F.col("rating")),
        "assessor": F.when(hit, user).otherwise(F.col("assessor")), "reviewed": F.when(hit, as_of).otherwise(F.col("reviewed")),
    }).drop("_m", "_r", "volumes")
    new = given.select("rt_id", F.inline("volumes"))
    return out, vois.join(new, ["rt_id", "volume_name"], "left_anti").unionByName(new)


def registered(files: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structure sets and volumes after files are registered; a SOP UID that is known keeps its set.

    files: sop_uid, label, patient_id, series_uid, rois. Volumes have no size.
    """
    added = files.join(sets.select("sop_uid"), "sop_uid", "left_anti")
    rows = added.select(F.col("sop_uid").alias("rt_id"), F.explode("rois").alias("r")).select("rt_id", F.col("r.number").alias("roi_number"), F.col("r.name").alias("roi_name"), F.lit(None).cast("double").alias("volume"))
    return sets.unionByName(added.drop("rois"), allowMissingColumns=True), rows


def instance_counts(series: DataFrame, batch: DataFrame, instances: DataFrame, compat: str = "reference") -> DataFrame:
    """Series with their instance_count after a batch: reference makes it the batch's own count, recount that of all images."""
    source = batch if compat == "reference" else instances.select("series_uid", "sop_uid").union(batch.select("series_uid", "sop_uid")).distinct()
    n = source.groupBy("series_uid").agg(F.count("*").alias("_n"))
    return series.join(n, "series_uid", "left").withColumn("instance_count", F.coalesce("_n", "instance_count")).drop("_n")


def to_match(series: DataFrame, instances: DataFrame) -> DataFrame:
    """(series_uid, path): series that are read to their end and not processed yet, with their first image (by ``place``)."""
    first = instances.groupBy("series_uid").agg(F.min_by("path", "place").alias("path"))
    return series.filter("fully_read AND status = 'UNPROCESSED'").select("series_uid").join(first, "series_uid")


def export_details(asked: DataFrame, series: DataFrame, structures: DataFrame) -> DataFrame:
    """Asked series (series_uid) with patient and study fields, N/A where there is nothing, and the number of structure sets with a file."""
    n = structures.filter("rt_path IS NOT NULL").groupBy("series_uid").agg(F.count("*").alias("n_structures"))
    out = series.join(asked.select("series_uid").distinct(), "series_uid", "left_semi").join(n, "series_uid", "left")
    shown = {c: or_default(F.col(c), "N/A") for c in ("patient_id", "patient_name", "series_description", "modality")}
    return out.withColumns(shown | {"instance_count": F.coalesce("instance_count", F.lit(0)), "n_structures": F.coalesce("n_structures", F.lit(0))}).select("series_uid", *shown, "instance_count", "n_structures")


def selection_status(asked: DataFrame, series: DataFrame, templates: DataFrame, exports: DataFrame) -> DataFrame:
    """Asked series with masked patient name, status, templates and export, or an error if there is no such series.

    templates: series_uid, template_name; exports: series_uid, transfer_status, task_id.
    """
    names = templates.groupBy("series_uid").agg(F.array_sort(F.collect_set("template_name")).alias("templates"))
    known = series.select("series_uid", mask(F.lit("patient_name"), F.col("patient_name")).alias("patient_name"), "status", F.lit(True).alias("_known"))
    out = asked.join(known, "series_uid", "left").join(names, "series_uid", "left").join(exports.select("series_uid", "transfer_status", "task_id"), "series_uid", "left")
    return out.withColumn("error", F.when(F.col("_known").isNull(), "Series not found")).drop("_known")


def last_run(statistics: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """(last_run): when statistics were last gathered, or half an hour before as_of."""
    return statistics.agg(F.coalesce(F.max("created"), as_of - F.make_interval(mins=F.lit(minutes))).alias("last_run"))


def retained(files: DataFrame, as_of: Column, delete_days: int = 30, compress_days: int = 7) -> DataFrame:
    """Rotated log files with what to do: delete those older than so many days, compress others that are older than some and not compressed, keep the rest."""
    rotated = F.col("path").rlike(r"\.log\.")
    older = lambda days: F.col("mtime") < as_of - F.make_interval(days=F.lit(days))
    return files.filter(rotated).withColumn("action", F.when(older(delete_days), "delete").when(older(compress_days) & ~F.col("path").endswith(".gz"), "compress").otherwise("keep"))


def stale(cached: Column, as_of: Column, minutes: int = 30) -> Column:
    """Whether a cached value is older than so many minutes, or was never made."""
    return F.coalesce(cached < as_of - F.make_interval(mins=F.lit(minutes)), F.lit(True))


def url_error(url: Column) -> Column:
    """Why a base URL is refused: it has no slash at its end. An empty one is not refused."""
    return F.when((F.coalesce(url, F.lit("")) != "") & ~url.endswith("/"), "no slash at the end of the base URL")


def with_slash(url: Column) -> Column:
    """A base URL that ends with one slash; empty stays. For those who mend an URL that url_error refuses."""
    return F.when(F.coalesce(url, F.lit("")) == "", url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/")))


#: What a query at each level asks to be returned (fixed values).
RETURN_KEYS = {
    "PATIENT": ["PatientID", "PatientName", "PatientBirthDate", "PatientSex"],
    "STUDY": ["PatientID", "PatientName", "StudyInstanceUID", "StudyDate", "StudyTime", "StudyDescription", "AccessionNumber", "ModalitiesInStudy", "NumberOfStudyRelatedSeries", "NumberOfStudyRelatedInstances"],
    "SERIES": ["PatientID", "PatientName", "StudyInstanceUID", "SeriesInstanceUID", "SeriesNumber", "SeriesDescription", "Modality", "NumberOfSeriesRelatedInstances"],
}


def query_dataset(level: str, params: dict[str, str]) -> dict[str, str]:
    """A query as it is sent: the keys of its level, empty if they are only asked for."""
    return {"QueryRetrieveLevel": level} | {k: params.get(k, "") for k in RETURN_KEYS.get(level, [])} | {k: v for k, v in params.items() if v}


def destination(destinations: DataFrame, title: str) -> DataFrame:
    """(host, port) of the active destination with a title: the first by id."""
    return destinations.filter((F.col("ae_title") == title) & F.col("is_active")).orderBy("id").limit(1).select("host", "port")


def available_structures(structures: DataFrame) -> DataFrame:
    """(value, label, model) of every structure of a model: label or, without one, name; by label when a page is taken."""
    label = F.coalesce(F.nullif("roi_label", F.lit("")), "name")
    return structures.select(label.alias("value"), label.alias("label"), "model")


def history(queries: DataFrame, user: str, status: str | None = None) -> DataFrame:
    """A user's queries, with one status if it is given; newest first when a page is taken."""
    rows = queries.filter(F.col("user") == user)
    return rows.filter(F.col("status") == status) if status else rows


def chain_status(runs: DataFrame, as_of: Column, minutes: int = 180) -> DataFrame:
    """(name, state) of each chain by its last run (started, finished): running, stale after so many minutes, or idle."""
    last = runs.groupBy("name").agg(F.max_by(F.struct("started", "finished"), "started").alias("r"))
    late = F.col("r.started") < as_of - F.make_interval(mins=F.lit(minutes))
    return last.select("name", F.when(F.col("r.finished").isNotNull(), "idle").when(late, "stale").otherwise("running").alias("state"))


def service_status(transactions: DataFrame, files: DataFrame, started: Column, as_of: Column, limit: float) -> DataFrame:
    """One row on the service: uptime, files and bytes stored, average size, share of the limit, transactions and failures."""
    t = transactions.agg(F.count("*").alias("transactions"), F.count_if(F.col("status") == "FAILURE").alias("failures"))
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("bytes"))
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))
    both = t.crossJoin(f)  # one row each
    return both.select(uptime(seconds).alias("uptime"), "files", "bytes", average_mb(F.col("bytes"), F.col("files")).alias("average_mb"), (F.col("bytes") * 100 / limit).alias("percent"), "transactions", "failures")


#: Share of the limit that a clean-up frees, and the least that it frees (fixed values).
FREED_SHARE, FREED_LEAST = 0.2, 10 << 30


def storage_check(usage: DataFrame, limit: float, cleanup: bool, least: float = FREED_LEAST) -> DataFrame:
    """Usage (n_files, used) with exceeded, and to_free: what a clean-up is to free, null if none is triggered."""
    over = F.col("used") >= limit
    return usage.withColumns({"exceeded": over, "to_free": F.when(over & F.lit(cleanup), F.lit(float(max(least, FREED_SHARE * limit))))})


def after_cleanup(checked: DataFrame, deleted: DataFrame, limit: float) -> DataFrame:
    """(n_files, used, exceeded, deleted, freed) after the files in ``deleted`` (size) are gone."""
    gone = deleted.agg(F.count("*").alias("deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed"))
    rows = checked.select("n_files", "used").crossJoin(gone)  # one row each
    return rows.select((F.col("n_files") - F.col("deleted")).alias("n_files"), (F.col("used") - F.col("freed")).alias("used"), (F.col("used") - F.col("freed") >= limit).alias("exceeded"), "deleted", "freed")
