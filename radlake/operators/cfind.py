"""Hierarchical queries: patient, study, series and image level, with wildcards and date ranges."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RESULTS = 10_000


def wildcard(column: Column, pattern: str) -> Column:
    """Case-insensitive; * is any text and ? any character, else equality."""
    if not set("*?") & set(pattern):
        return F.lower(column) == pattern.lower()
    body = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\^$.|+()\[\]{}])", r"\\\1", c) for c in pattern)
    return column.rlike(f"(?is)^{body}$")


def _day(text: str) -> dt.date | None:
    try:
        return dt.datetime.strptime(text, "%Y%m%d").date()
    except ValueError:
        return None


def date_match(column: Column, value: str, strict: bool = False) -> Column:
    """A day, or a range a-b with both ends; what can't be read filters nothing.

    An open range filters nothing either, unless ``strict``.
    """
    if set("*?") & set(value):
        return wildcard(F.date_format(column, "yyyyMMdd"), value)
    if "-" in value:
        low, high = value.split("-", 1)
        a, b = _day(low), _day(high)
        if a and b:
            return column.between(a, b)
        if strict and a and not high:
            return column >= F.lit(a)
        if strict and b and not low:
            return column <= F.lit(b)
        return F.lit(True)
    day = _day(value)
    return column == F.lit(day) if day else F.lit(True)


def find(catalog: DataFrame, keys: dict[str, str], fields: dict[str, str], order: list[str], max_results: int = MAX_RESULTS, date_fields: tuple[str, ...] = ("study_date",), strict: bool = False) -> DataFrame:
    """Rows of a joined level that match all keys; ``fields`` renames columns to tags, nulls are empty.

    At most max_results rows, in the order given, which should be total.
    """
    for column, pattern in keys.items():
        if pattern:
            catalog = catalog.filter(date_match(F.col(column), pattern, strict) if column in date_fields else wildcard(F.col(column), pattern))
    shown = []
    for column, tag in fields.items():
        text = F.date_format(column, "yyyyMMdd") if column in date_fields else F.col(column).cast("string")
        shown.append(F.coalesce(text, F.lit("")).alias(tag))
    return catalog.orderBy(*order).limit(max_results).select(*shown)


def retrieve(catalog: DataFrame, ids: dict[str, str]) -> DataFrame:
    """Rows whose ids equal those given, without regard to case and wildcards."""
    for column, value in ids.items():
        catalog = catalog.filter(F.lower(column) == value.lower())
    return catalog


def with_rt(images: DataFrame, structures: DataFrame, modality: str | None, max_results: int = MAX_RESULTS, order: str = "series_uid") -> DataFrame:
    """Image rows and structure-set rows under one another; each side has the limit of its own.

    RTSTRUCT asks for structure sets only, another modality for images only,
    none or * for both.
    """
    a, b = images.orderBy(order).limit(max_results), structures.orderBy(order).limit(max_results)
    if modality == "RTSTRUCT":
        return b
    if modality and modality != "*":
        return a
    return a.unionByName(b, allowMissingColumns=True)


#: Tags of each level and the columns they come from (fixed values).
_PATIENT = {"PatientID": "patient_id", "PatientName": "patient_name", "PatientBirthDate": "birth_date", "PatientSex": "gender"}
_STUDY = {"StudyInstanceUID": "study_uid", "StudyDate": "study_date", "StudyTime": "study_time", "StudyDescription": "study_description", "AccessionNumber": "accession", "StudyID": "study_id"}
_SERIES = {"SeriesInstanceUID": "series_uid", "SeriesDate": "series_date", "SeriesTime": "", "SeriesDescription": "series_description", "SeriesNumber": ""}
#: Which tags a level's query is filtered by; all others are only returned.
FILTERS = {
    "PATIENT": ["PatientID", "PatientName"],
    "STUDY": ["PatientID", "PatientName", "StudyInstanceUID", "StudyDate", "StudyDescription", "AccessionNumber"],
    "SERIES": ["PatientID", "PatientName", "StudyInstanceUID", "StudyDate", "StudyDescription", "SeriesInstanceUID", "SeriesDescription"],
    "IMAGE": ["PatientID", "PatientName", "StudyInstanceUID", "StudyDate", "StudyDescription", "SeriesInstanceUID", "SeriesDescription", "SOPInstanceUID"],
}
RT_SOP_CLASS = "1.2.840.10008.5.1.4.1.1.481.3"


def _matching(df: DataFrame, level: str, params: dict[str, str], columns: dict[str, str], strict: bool) -> DataFrame:
    for tag in FILTERS[level]:
        if params.get(tag):
            column = columns[tag]
            df = df.filter(date_match(F.col(column), params[tag], strict) if tag == "StudyDate" else wildcard(F.col(column), params[tag]))
    return df


def _answers(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Tags as text; null, and what the table has no column for, is empty."""
    types, out = dict(df.dtypes), []
    for tag, column in columns.items():
        if isinstance(column, str) and column not in types:
            value = F.lit("")
        elif isinstance(column, str):
            value = F.date_format(column, "yyyyMMdd") if types[column] == "date" else F.col(column).cast("string")
        else:
            value = column
        out.append(F.coalesce(value, F.lit("")).alias(tag))
    return df.select(*out)


def _first(rows: DataFrame, most: int | None, *order: str) -> DataFrame:
    """The first rows by order; all, if there is no limit: a limit passes its rows through one task."""
    return rows if most is None else rows.orderBy(*order).limit(most)


def query(level: str, params: dict[str, str], catalog: dict[str, DataFrame], max_results: int | None = MAX_RESULTS, strict: bool = False) -> DataFrame:
    """Answers to a query at a level: PATIENT, STUDY (if none is given), SERIES or IMAGE; another level has none.

    catalog: patients, studies, series, instances and rt (returned structure
    sets). Series and images come with structure sets, each side limited on its
    own; Modality RTSTRUCT asks for these only, another one but * for images
    only. Structure sets are found by their own re-identified UIDs, at image
    level by the catalog's study UID; those without a series count in the limit
    but have no answer. max_results None: all answers, in no order.
    """
    level = (level or "STUDY").upper()
    studies = catalog["studies"].join(catalog["patients"], "patient_id")
    if level not in FILTERS:
        return studies.limit(0).select()
    if level == "PATIENT":
        found = _matching(catalog["patients"], level, params, _PATIENT, strict)
        return _answers(_first(found, max_results, "patient_id"), {"QueryRetrieveLevel": F.lit(level), **_PATIENT})
    if level == "STUDY":
        found = _first(_matching(studies, level, params, _PATIENT | _STUDY, strict), max_results, "study_uid")
        n = catalog["series"].groupBy("study_uid").agg(F.sum("instance_count").alias("_n"))
        number = F.coalesce(F.col("_n"), F.lit(0)).cast("string")
        return _answers(found.join(n, "study_uid", "left"), {"QueryRetrieveLevel": F.lit(level), **_PATIENT, **_STUDY, "ModalitiesInStudy": "modality", "NumberOfStudyRelatedInstances": number})
    series = catalog["series"].join(studies, "study_uid")
    tags = {"QueryRetrieveLevel": F.lit(level), **_PATIENT, **_STUDY, **_SERIES}
    rt = catalog["rt"].filter("rt_path IS NOT NULL").withColumnRenamed("series_uid", "_of").join(series.withColumnRenamed("series_uid", "_of").withColumn("_known", F.lit(True)), "_of", "left")
    of_rt = _PATIENT | _STUDY | {"SeriesInstanceUID": "rt_series_uid", "SeriesDescription": "series_description", "SOPInstanceUID": "rt_sop_uid"}
    if level == "SERIES":
        images = _first(_matching(series, level, params, _PATIENT | _STUDY | _SERIES, strict), max_results, "series_uid")
        shown = tags | {"Modality": F.lit(""), "NumberOfSeriesRelatedInstances": F.coalesce(F.col("instance_count"), F.lit(0)).cast("string")}
        rt = _matching(rt, level, params, of_rt | {"StudyInstanceUID": "rt_study_uid"}, strict)
        description = F.coalesce(F.nullif("series_description", F.lit("")), F.lit("RT Structure Set"))
        of_set = tags | {"SeriesInstanceUID": "rt_series_uid", "SeriesDescription": description, "Modality": F.lit("RTSTRUCT"), "NumberOfSeriesRelatedInstances": F.lit("1")}
    else:
        joined = catalog["instances"].select("sop_uid", "series_uid", "path", *[c for c in ("sop_class_uid", "instance_number") if c in catalog["instances"].columns]).join(series, "series_uid")
        images = _first(_matching(joined, level, params, _PATIENT | _STUDY | _SERIES | {"SOPInstanceUID": "sop_uid"}, strict), max_results, "sop_uid", "path")
        shown = tags | {"Modality": F.lit(""), "SOPInstanceUID": "sop_uid", "SOPClassUID": "sop_class_uid", "InstanceNumber": "instance_number"}
        rt = _matching(rt, level, params, of_rt, strict)
        of_set = tags | {"SeriesInstanceUID": "rt_series_uid", "Modality": F.lit("RTSTRUCT"), "SOPInstanceUID": "rt_sop_uid"}
        of_set |= {"SOPClassUID": F.coalesce(F.nullif("rt_sop_class_uid", F.lit("")), F.lit(RT_SOP_CLASS)), "InstanceNumber": F.lit("1")}
    images = _answers(images, shown)
    sets = _answers(_first(rt, max_results, "rt_id").filter("_known"), of_set)
    modality = (params.get("Modality") or "*").upper()
    return sets if modality == "RTSTRUCT" else images if modality != "*" else images.unionByName(sets)


def retrieval_paths(catalog: dict[str, DataFrame], ids: dict[str, str], existing: DataFrame | None = None, max_results: int = MAX_RESULTS) -> DataFrame:
    """(path) of images and structure sets with exactly these ids (patient_id, study_uid, series_uid, sop_uid), without regard to case.

    Structure sets are found by their re-identified UIDs. existing: (path) of the
    files there are; others are left out, after the limit.
    """
    series = catalog["series"].join(catalog["studies"], "study_uid")
    images = retrieve(catalog["instances"].drop("study_uid").join(series.drop("modality"), "series_uid"), ids).orderBy("sop_uid", "path").limit(max_results)
    of_rt = {"patient_id": "patient_id", "study_uid": "rt_study_uid", "series_uid": "rt_series_uid", "sop_uid": "rt_sop_uid"}
    sets = catalog["rt"].filter("rt_path IS NOT NULL").withColumnRenamed("series_uid", "_of").join(series.select(F.col("series_uid").alias("_of"), "patient_id"), "_of", "left")
    sets = retrieve(sets, {of_rt[k]: v for k, v in ids.items()}).orderBy("rt_id").limit(max_results)
    paths = images.select("path").union(sets.select("rt_path")).filter("path IS NOT NULL AND path <> ''")
    return paths if existing is None else paths.join(existing.select("path").distinct(), "path", "left_semi")


def push_paths(catalog: dict[str, DataFrame], series: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(series_uid, path) of all files of the asked series (series_uid) and of their structure sets; exact UIDs, no limit."""
    asked = series.select("series_uid").distinct()
    sets = catalog["rt"].filter("rt_path IS NOT NULL").select("series_uid", F.col("rt_path").alias("path"))
    files = catalog["instances"].select("series_uid", "path").unionByName(sets).join(asked, "series_uid")
    return files if existing is None else files.join(existing.select("path").distinct(), "path", "left_semi")


def range_text(low: Column, high: Column) -> Column:
    """The range of two days as a query has it: a-b, a- or -b; empty if there is neither."""
    a, b = F.date_format(low, "yyyyMMdd"), F.date_format(high, "yyyyMMdd")
    return F.when(a.isNull() & b.isNull(), "").otherwise(F.concat(F.coalesce(a, F.lit("")), F.lit("-"), F.coalesce(b, F.lit(""))))
