"""De-identification and its way back.

What the studied application draws at random comes from HMACs of the identifiers
under a secret key, which every function takes: reruns agree, and nobody without
the key can try identifiers until one fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType
from pyspark.sql.window import Window as W

from ..functions.scalar import digits, keyed
from ..functions.tags import forms

UID_PREFIX = "1.2.826.0.1.3680043.10.1561"
#: Tags that are masked when present, and free-text tags (fixed values).
MASKED = [
    "PatientName", "ReferringPhysicianName", "PerformingPhysicianName", "OperatorsName", "PhysiciansOfRecord", "RequestingPhysician", "ConsultingPhysicianName", "ResponsiblePerson", "ReviewerName",
    "InstitutionName", "InstitutionAddress", "InstitutionalDepartmentName", "StationName", "ReferringPhysicianAddress", "PersonAddress", "TelephoneNumbers", "PatientTelephoneNumbers",
    "InstitutionCodeSequence", "PhysiciansReadingStudyIdentificationSequence", "OperatorIdentificationSequence", "ReferringPhysicianIdentificationSequence",
    "OtherPatientIDs", "OtherPatientIDsSequence", "MedicalRecordLocator", "PatientInsurancePlanCodeSequence", "DeviceSerialNumber", "PlateID", "GeneratorID", "CassetteID", "GantryID",
    "AccessionNumber", "StudyID", "RequestedProcedureID", "ScheduledProcedureStepID", "FillerOrderNumberImagingServiceRequest", "PlacerOrderNumberImagingServiceRequest",
]
FREE_TEXT = [
    "StudyDescription", "SeriesDescription", "ImageComments", "AdditionalPatientHistory", "StudyComments", "PatientComments", "RequestedProcedureDescription",
    "PerformedProcedureStepDescription", "ProtocolName", "AcquisitionProtocolDescription",
]


#: Tags that name a patient or kin as well; masked like the others.
ALSO_MASKED = ["PatientBirthName", "PatientMotherBirthName", "OtherPatientNames", "PatientAddress"]
#: Dates that are replaced, and identifiers that become # as nothing maps them (fixed values).
DATES = ["StudyDate", "SeriesDate", "AcquisitionDate", "ContentDate", "PatientBirthDate"]
UNMAPPED = ["AccessionNumber", "StudyID"]


def _keys(keywords: list[str]) -> list[str]:
    return [k for w in keywords for k in forms(w)]


def _private(key: Column) -> Column:
    """An odd group number, or a name that only private tags have."""
    return key.rlike(r"^\([0-9A-Fa-f]{3}[13579bdfBDF],") | key.rlike(r"(?i)^(private |\[)")


def masked_tags(tags: Column) -> Column:
    """Masked and free-text tags to #, whether they stand under keyword, name or number; private tags go."""
    kept = F.map_filter(tags, lambda k, v: ~_private(k))
    return F.transform_values(kept, lambda k, v: F.when(k.isin(_keys(MASKED + ALSO_MASKED + FREE_TEXT + UNMAPPED)), F.lit("#")).otherwise(v))


def deidentified_tags(tags: Column, study_uid: Column, series_uid: Column, frame_uid: Column, sop_uid: Column, patient: Column, day: Column) -> Column:
    """A map of tags fit to leave the house: masked, with new UIDs, pseudonym and dates, under every form of their keys.

    Nothing is added that is not there; times of day and other tags stay. Dates
    and times together (DT) become the day at midnight.
    """
    put = {"StudyInstanceUID": study_uid, "SeriesInstanceUID": series_uid, "FrameOfReferenceUID": frame_uid, "SOPInstanceUID": sop_uid, "PatientID": patient}
    put |= {d: F.date_format(day, "yyyyMMdd") for d in DATES} | {"AcquisitionDateTime": F.date_format(day, "yyyyMMdd000000")}

    def value(k: Column, v: Column) -> Column:
        out = F.when(F.lit(False), v)
        for keyword, new in put.items():
            out = out.when(k.isin(forms(keyword)), new)
        return out.otherwise(v)

    return F.transform_values(masked_tags(tags), value)


def frame_uid(deid_series_uid: Column, series_uid: Column, secret: bytes) -> Column:
    """The frame of reference of a series: its new UID and four digits."""
    return F.concat_ws(".", deid_series_uid, digits(series_uid, 1000, 9999, "frame", secret).cast("string"))


def _behind(n: Column) -> Column:
    """The number behind a UID that was drawn before; the first has none."""
    return F.when(n > 0, n.cast("string")).otherwise("")


def apart(drawn: DataFrame, key: str, within: list[str], length: Column, known: DataFrame | None = None) -> DataFrame:
    """(within, key, uid): of keys that drew the same UID the first keeps it, the others get a number behind its last digits.

    drawn: within, key, uid (one row per key), UIDs of a fixed length, so that a
    longer one is nobody's draw. known: rows of UIDs given earlier, which stay;
    new keys of the same digits are numbered behind them.
    """
    mine = [*within, key]
    if known is None:
        number = F.row_number().over(W.partitionBy(*within, "uid").orderBy(key)) - 1
        return drawn.withColumn("_n", number).select(*mine, F.concat("uid", _behind(F.col("_n"))).alias("uid"))
    every = drawn.withColumn("_new", F.lit(True)).join(known.select(*mine, F.col("uid").alias("_given")), mine, "full")
    every = every.withColumn("_base", F.coalesce(F.substring(F.col("_given"), F.lit(1), length), "uid"))
    number = F.when(F.col("_given").isNotNull(), F.coalesce(F.nullif(F.substring(F.col("_given"), length + 1, F.lit(64)), F.lit("")).cast("int"), F.lit(0)))
    same = W.partitionBy(*within, "_base")
    every = every.withColumn("_top", F.max(number).over(same)).withColumn("_n", F.row_number().over(same.orderBy(F.col("_given").isNotNull(), key)) + F.coalesce("_top", F.lit(-1)))
    uid = F.concat("_base", _behind(F.col("_n")))
    return every.filter("_new").select(*mine, F.coalesce("_given", uid).alias("uid"))


def _image_digits(secret: bytes) -> Column:
    """What an image draws behind its series' UID."""
    image = F.col("sop_uid")
    return F.concat_ws(".", digits(image, 10**6, 10**7 - 1, "sop1", secret).cast("string"), digits(image, 100, 999, "sop2", secret).cast("string"))


def with_sop_uids(images: DataFrame, secret: bytes, within: list[str]) -> DataFrame:
    """Images with deid_sop_uid, as sop_uids() has it without known ones; null where deid_series_uid is.

    within: columns that name a series, before and after. By a window in which
    copies of an image count once: rows that lie together by one of these columns
    are not shuffled again.
    """
    n = F.dense_rank().over(W.partitionBy(*within, "_drawn").orderBy("sop_uid")) - 1
    rows = images.withColumn("_drawn", F.when(F.col("deid_series_uid").isNotNull(), _image_digits(secret))).withColumn("_n", n)
    return rows.withColumn("deid_sop_uid", F.concat("deid_series_uid", F.lit("."), "_drawn", _behind(F.col("_n")))).drop("_drawn", "_n")


def sop_uids(instances: DataFrame, secret: bytes, known: DataFrame | None = None) -> DataFrame:
    """(deid_series_uid, sop_uid, deid_sop_uid): the series' new UID, seven digits and three; images of a series never share one.

    instances: deid_series_uid, sop_uid, in any number of copies. known: earlier rows.
    """
    drawn = instances.select("deid_series_uid", "sop_uid").distinct().withColumn("uid", F.concat_ws(".", "deid_series_uid", _image_digits(secret)))
    given = known.select("deid_series_uid", "sop_uid", F.col("deid_sop_uid").alias("uid")) if known is not None else None
    return apart(drawn, "sop_uid", ["deid_series_uid"], F.length("deid_series_uid") + 12, given).select("deid_series_uid", "sop_uid", F.col("uid").alias("deid_sop_uid"))


def deidentify(series: DataFrame, studies: DataFrame, instances: DataFrame, exports: DataFrame, chosen: DataFrame, secret: bytes) -> dict[str, DataFrame]:
    """The four tables after the chosen series (series_uid, archive) are de-identified, in one step.

    Series get UIDs, date and status, studies UID and date, images their SOP UIDs,
    exports a pending row. A study that has a new UID already keeps it.
    """
    known = studies.filter("deid_study_uid IS NOT NULL").select("study_uid", "deid_study_uid")
    done = chosen.join(numbered_series(series, study_uids(studies, secret, known)), "series_uid")
    done = done.withColumns({"deid_frame_uid": frame_uid(F.col("deid_series_uid"), F.col("series_uid"), secret), "day": study_date(F.col("study_uid"), secret)})
    return write_back(series, studies, instances, exports, done, secret)


def write_back(series: DataFrame, studies: DataFrame, instances: DataFrame, exports: DataFrame, done: DataFrame, secret: bytes) -> dict[str, DataFrame]:
    """The four tables after de-identification; rows of series that are not done stay as they are.

    done: (series_uid, deid_series_uid, deid_study_uid, deid_frame_uid, study_uid,
    day, archive). Series get their UIDs, date and status, studies UID and date,
    images their SOP UIDs; an export is added or goes back to pending. The birth
    date is not overwritten.
    """
    of_series = done.select("series_uid", F.col("deid_series_uid").alias("_s"), F.col("deid_frame_uid").alias("_f"), F.col("day").alias("_d"))
    new_series = series.join(of_series, "series_uid", "left").withColumns({
        "deid_series_uid": F.coalesce("_s", "deid_series_uid"), "deid_frame_uid": F.coalesce("_f", "deid_frame_uid"), "deid_series_date": F.coalesce("_d", "deid_series_date"),
        "status": F.when(F.col("_s").isNotNull(), "DEIDENTIFIED_SUCCESSFULLY").otherwise(F.col("status")),
    }).drop("_s", "_f", "_d")
    of_study = done.groupBy("study_uid").agg(F.max("deid_study_uid").alias("_s"), F.max("day").alias("_d"))
    new_studies = studies.join(of_study, "study_uid", "left").withColumns({"deid_study_uid": F.coalesce("_s", "deid_study_uid"), "deid_study_date": F.coalesce("_d", "deid_study_date")}).drop("_s", "_d")
    images = instances.join(done.select("series_uid", "deid_series_uid"), "series_uid", "left")
    images = with_sop_uids(images.withColumnRenamed("deid_sop_uid", "_before"), secret, ["series_uid", "deid_series_uid"])
    new_instances = images.withColumn("deid_sop_uid", F.coalesce("deid_sop_uid", "_before")).select(*instances.columns)
    pending = done.select("series_uid", "archive", F.lit("PENDING").alias("transfer_status"))
    new_exports = exports.join(pending.select("series_uid"), "series_uid", "left_anti").unionByName(pending, allowMissingColumns=True)
    return {"series": new_series, "studies": new_studies, "instances": new_instances, "exports": new_exports}


def summary(done: DataFrame) -> DataFrame:
    """(patients, studies, series, files) of one run; done: patient_id, study_uid, files."""
    return done.agg(F.count_distinct("patient_id").alias("patients"), F.count_distinct("study_uid").alias("studies"), F.count("*").alias("series"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


#: Values of a re-identified structure set that no table has (fixed values).
ACCESSION_DEFAULT, PHYSICIAN = "202514789", "DRAW"


def reidentified(sets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Structure sets with the patient's and study's own fields.

    sets: deid_series_uid and columns named by keyword; catalog: deid_series_uid
    and the catalog's columns. What the catalog has no value for stays as it is,
    but the accession number gets a default and the study id is empty.
    """
    day = lambda c: F.date_format(c, "yyyyMMdd")
    known = {
        "PatientID": F.col("patient_id"), "PatientName": F.col("patient_name"), "PatientBirthDate": day("birth_date"), "PatientSex": F.col("gender"), "StudyInstanceUID": F.col("study_uid"),
        "StudyDescription": F.col("study_description"), "StudyDate": day("study_date"), "StudyTime": F.col("study_time"), "SeriesDescription": F.col("series_description"),
    }
    joined = sets.join(catalog, "deid_series_uid")
    out = {k: F.coalesce(F.nullif(v, F.lit("")), F.col(k)) for k, v in known.items() if k in sets.columns}
    out |= {"AccessionNumber": F.coalesce(F.nullif("accession", F.lit("")), F.lit(ACCESSION_DEFAULT)), "StudyID": F.coalesce("study_id", F.lit("")), "ReferringPhysicianName": F.lit(PHYSICIAN)}
    return joined.withColumns(out).select(*dict.fromkeys([*sets.columns, *out]))


def with_frame(items: Column, frame: Column, field: str = "frame_uid") -> Column:
    """Nested items with the frame of reference replaced, where there is one to put."""
    return F.transform(items, lambda x: F.when(frame.isNotNull() & (frame != ""), x.withField(field, frame)).otherwise(x))


def anywhere(items: Column, kind: DataType, new: dict[str, Callable[[Column], Column]]) -> Column:
    """Nested items with the named fields replaced wherever they stand in the tree of structs and arrays; kind: its type."""
    if isinstance(kind, ArrayType):
        return F.transform(items, lambda x: anywhere(x, kind.elementType, new))
    if isinstance(kind, StructType):
        fields = [(new[f.name](items[f.name]) if f.name in new else anywhere(items[f.name], f.dataType, new)).alias(f.name) for f in kind.fields]
        return F.when(items.isNotNull(), F.struct(*fields))
    return items


def reframed(sets: DataFrame, columns: list[str], frame: Column, fields: tuple[str, ...] = ("frame_uid", "referenced_frame_uid")) -> DataFrame:
    """Sets whose frames of reference (0020,0052) and (3006,0024) become ``frame`` at every depth of the columns; a set without a frame to put stays."""
    put = {f: lambda old: F.when(old.isNotNull() & frame.isNotNull() & (frame != ""), frame).otherwise(old) for f in fields}
    return sets.withColumns({c: anywhere(F.col(c), sets.schema[c].dataType, put) for c in columns})


def remap_references(sets: DataFrame, mapping: DataFrame, key: str, references: str) -> DataFrame:
    """Sets whose array of referenced UIDs goes through (uid_from, uid_to), in order; what is not mapped passes through."""
    one = mapping.groupBy(F.col("uid_from").alias("_from")).agg(F.min("uid_to").alias("_to"))
    parts = sets.select(key, F.posexplode(references).alias("_at", "_from")).join(one, "_from", "left")
    back = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_to", "_from").alias("_uid")))).alias("_r"))
    return sets.join(back, key, "left").withColumn(references, F.coalesce(F.col("_r._uid"), F.col(references))).drop("_r")


def with_properties(rois: DataFrame, properties: DataFrame) -> DataFrame:
    """ROIs renamed, recoloured and retyped; rois: rt_id, number, name, color, type; properties: name, label, color, type.

    A name that several properties have is ambiguous and changes nothing; an
    empty property leaves what there is; colours that are not three numbers are
    not taken.
    """
    one = F.count("*") == 1
    p = properties.groupBy(F.col("name").alias("_n")).agg(*[F.when(one, F.nullif(F.first(c), F.lit(""))).alias(f"_{c}") for c in ("label", "color", "type")])
    joined = rois.join(p, F.col("name") == F.col("_n"), "left")
    color = F.when(F.size(F.split("_color", r"\\")) == 3, F.col("_color"))
    return joined.select("rt_id", "number", F.coalesce("_label", "name").alias("name"), F.coalesce(color, "color").alias("color"), F.coalesce("_type", "type").alias("type"))


def numbered(items: DataFrame, names: DataFrame, name: str = "roi_name") -> DataFrame:
    """Items (rt_id, number) with the name of that number: the first by its place in the set, as names can share a number."""
    first = names.groupBy("rt_id", "number").agg(F.min_by(name, "place").alias(name))
    return items.join(first, ["rt_id", "number"], "left")


def added_rois(rois: DataFrame, wanted: DataFrame) -> DataFrame:
    """Empty ROIs behind those there are, numbered from the largest number on, yellow and ORGAN if nothing is said; names that exist are left out.

    wanted: rt_id, place, label, color, type.
    """
    missing = wanted.join(rois.select("rt_id", F.col("name").alias("label")), ["rt_id", "label"], "left_anti")
    top = rois.groupBy("rt_id").agg(F.max("number").alias("_top"))
    n = F.coalesce("_top", F.lit(0)) + F.row_number().over(W.partitionBy("rt_id").orderBy("place"))
    color = F.when(F.size(F.split("color", r"\\")) == 3, F.col("color")).otherwise("255\\255\\0")
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("ORGAN"))
    return missing.join(top, "rt_id", "left").select("rt_id", n.cast("int").alias("number"), F.col("label").alias("name"), color.alias("color"), kind.alias("type"))


def voi_rows(sets: DataFrame) -> DataFrame:
    """(rt_id, volume_name) of every ROI with a name; sets: rt_id, rois (array of number and name)."""
    return sets.select("rt_id", F.explode("rois").alias("r")).select("rt_id", F.col("r.name").alias("volume_name")).filter(F.coalesce("volume_name", F.lit("")) != "")


def study_uids(studies: DataFrame, secret: bytes, known: DataFrame | None = None, widths: tuple[int, ...] = (3, 2, 3)) -> DataFrame:
    """(study_uid, deid_study_uid): groups of digits behind the prefix, of the given widths; no two studies share one.

    Studies that draw the same digits are told apart by a number behind the last
    group, in the order of their UIDs. known: (study_uid, deid_study_uid) given
    before, which stay.
    """
    study = F.col("study_uid")
    parts = [F.lit(UID_PREFIX)] + [digits(study, 10 ** (n - 1), 10**n - 1, f"study{k}", secret).cast("string") for k, n in enumerate(widths)]
    drawn = studies.select("study_uid").distinct().withColumn("uid", F.concat_ws(".", *parts))
    given = known.select("study_uid", F.col("deid_study_uid").alias("uid")) if known is not None else None
    return apart(drawn, "study_uid", [], F.lit(len(UID_PREFIX) + len(widths) + sum(widths)), given).select("study_uid", F.col("uid").alias("deid_study_uid"))


def with_series_uids(rows: DataFrame) -> DataFrame:
    """Rows (study_uid, series_uid, deid_study_uid, ..) with deid_series_uid: the series of a study are numbered, in any number of rows."""
    n = F.dense_rank().over(W.partitionBy("study_uid").orderBy("series_uid"))
    return rows.withColumn("_n", n).withColumn("deid_series_uid", F.concat_ws(".", "deid_study_uid", F.col("_n").cast("string"))).drop("_n")


def numbered_series(series: DataFrame, studies: DataFrame) -> DataFrame:
    """(series_uid, study_uid, deid_study_uid, deid_series_uid)"""
    return with_series_uids(series.select("series_uid", "study_uid").distinct().join(studies, "study_uid")).select("series_uid", "study_uid", "deid_study_uid", "deid_series_uid")


def series_uids(series: DataFrame, studies: DataFrame) -> DataFrame:
    """(series_uid, deid_series_uid): numbered in each study."""
    return numbered_series(series, studies).select("series_uid", "deid_series_uid")


def study_date(study_uid: Column, secret: bytes) -> Column:
    """A day from 2000-01-01 to 2020-12-30, one for each study."""
    return F.date_add(F.lit("2000-01-01").cast("date"), digits(study_uid, 0, 7668, "date", secret).cast("int"))


def pseudonym(patient: Column, secret: bytes, series: Column | None = None) -> Column:
    """A pseudonym per patient, or per series if one is given."""
    key = patient if series is None else F.concat_ws("/", patient, series)
    return F.concat(F.lit("P"), F.substring(keyed(key, secret), 1, 16))
