"""De-identification lists and colours against those of the studied application."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from radlake.functions import scalar as S
from radlake.functions.tags import forms
from radlake.operators import deid as D
from radlake.queries import QUERIES

MASKED = """PatientName ReferringPhysicianName PerformingPhysicianName OperatorsName PhysiciansOfRecord RequestingPhysician ConsultingPhysicianName ResponsiblePerson ReviewerName
InstitutionName InstitutionAddress InstitutionalDepartmentName StationName ReferringPhysicianAddress PersonAddress TelephoneNumbers PatientTelephoneNumbers InstitutionCodeSequence
PhysiciansReadingStudyIdentificationSequence OperatorIdentificationSequence ReferringPhysicianIdentificationSequence OtherPatientIDs OtherPatientIDsSequence MedicalRecordLocator
PatientInsurancePlanCodeSequence DeviceSerialNumber PlateID GeneratorID CassetteID GantryID AccessionNumber StudyID RequestedProcedureID ScheduledProcedureStepID
FillerOrderNumberImagingServiceRequest PlacerOrderNumberImagingServiceRequest""".split()
FREE_TEXT = """StudyDescription SeriesDescription ImageComments AdditionalPatientHistory StudyComments PatientComments RequestedProcedureDescription PerformedProcedureStepDescription
ProtocolName AcquisitionProtocolDescription""".split()


def test_every_listed_tag_is_masked(spark):
    assert len(MASKED) == 36 and len(FREE_TEXT) == 10
    tags = {t: "secret" for t in MASKED + FREE_TEXT} | {"Modality": "CT", "(0009,0010)": "secret"}
    got = spark.createDataFrame([(tags,)], "tags map<string,string>").select(D.masked_tags(F.col("tags")).alias("t")).first().t
    assert got == {t: "#" for t in MASKED + FREE_TEXT} | {"Modality": "CT"}


def test_every_form_of_a_key_is_masked(spark):
    """No value that was put in comes out, whatever the form of its key."""
    tags = {k: f"secret {n}" for n, k in enumerate(x for t in MASKED + FREE_TEXT for x in forms(t))}
    assert {"(0010,0010)", "Patient's Name", "PatientName", "(0008,103e)"} <= set(tags)
    tags |= {"(0009,1001)": "secret", "Private Creator": "secret", "Private tag data": "secret", "[Vendor Tag]": "secret", "(0019,10AB)": "secret"}
    for n, t in enumerate(["StudyInstanceUID", "SeriesInstanceUID", "FrameOfReferenceUID", "SOPInstanceUID", "PatientID", *D.DATES, "AcquisitionDateTime"]):
        tags |= {k: f"secret {t} {n}" for k in forms(t)}
    tags |= {"Modality": "CT", "(0018,0050)": "2.5", "StudyTime": "1200"}
    new = {"study": "9.1", "series": "9.1.1", "frame": "9.1.1.1234", "sop": "9.1.1.7.3", "patient": "P1"}
    row = spark.createDataFrame([(tags, *new.values(), dt.date(2001, 2, 3))], "tags map<string,string>, study string, series string, frame string, sop string, patient string, day date")
    got = row.select(D.deidentified_tags(*map(F.col, ("tags", "study", "series", "frame", "sop", "patient", "day"))).alias("t")).first().t
    assert not [k for k, v in got.items() if "secret" in v]
    assert got["(0020,000D)"] == got["Study Instance UID"] == "9.1" and got["(0020,0052)"] == "9.1.1.1234" and got["SOPInstanceUID"] == "9.1.1.7.3" and got["Patient ID"] == "P1"
    assert got["(0010,0030)"] == got["Study Date"] == "20010203" and got["AcquisitionDateTime"] == "20010203000000" and got["AccessionNumber"] == got["(0020,0010)"] == "#"
    assert (got["Modality"], got["(0018,0050)"], got["StudyTime"]) == ("CT", "2.5", "1200") and not {"(0009,1001)", "Private Creator", "[Vendor Tag]"} & set(got)


KEY = b"a secret"


def test_uids_have_their_shapes(spark):
    row = spark.range(50).select(F.col("id").cast("string").alias("study_uid"))
    study = {r.deid_study_uid for r in D.study_uids(row, KEY).collect()}
    assert len(study) == 50 and all(re.fullmatch(r"1\.2\.826\.0\.1\.3680043\.10\.1561\.\d{3}\.\d{2}\.\d{3}", u) for u in study)
    got = row.select(D.frame_uid(F.lit("9.1"), F.col("study_uid"), KEY).alias("f"), D.study_date(F.col("study_uid"), KEY).alias("d")).collect()
    assert all(re.fullmatch(r"9\.1\.\d{4}", r.f) and dt.date(2000, 1, 1) <= r.d <= dt.date(2020, 12, 30) for r in got)
    images = row.select(F.lit("9.1").alias("deid_series_uid"), F.col("study_uid").alias("sop_uid"))
    got = D.sop_uids(images.union(images), KEY).collect()
    assert len(got) == len({r.deid_sop_uid for r in got}) == 50 and all(re.fullmatch(r"9\.1\.\d{7}\.\d{3}", r.deid_sop_uid) for r in got)


def test_no_two_studies_share_a_uid(spark):
    """Where 175 pairs drew the same digits."""
    from radlake.sources import tables as T

    studies = T.studies(spark, "/root/testdata/sf0.1")
    n = studies.select("study_uid").distinct().count()
    got = D.study_uids(studies, KEY)
    assert got.count() == n == got.select("deid_study_uid").distinct().count()
    assert got.filter(F.length("deid_study_uid") > len(D.UID_PREFIX) + 11).count() > 50  # drawn by another study as well
    images = D.sop_uids(spark.range(20000).selectExpr("'9.1' AS deid_series_uid", "CAST(id AS STRING) AS sop_uid"), KEY)
    assert images.select("deid_sop_uid").distinct().count() == 20000


def test_given_uids_stay(spark):
    """Few digits, so that most studies clash: whatever the order of arrival, UIDs differ and earlier ones stay."""
    studies = spark.range(400).select(F.col("id").cast("string").alias("study_uid"))
    known, seen = None, {}
    for part in (0, 1, 2, 3):
        rows = studies.filter(F.col("study_uid").cast("int") % 4 <= part) if part < 3 else studies.filter("int(study_uid) > 100")
        got = {r.study_uid: r.deid_study_uid for r in D.study_uids(rows, KEY, known, widths=(1, 1)).collect()}
        assert all(got[k] == v for k, v in seen.items() if k in got) and rows.count() == len(got)
        seen |= got
        assert len(set(seen.values())) == len(seen)
        known = spark.createDataFrame(list(seen.items()), "study_uid string, deid_study_uid string")
    assert len(seen) == 375


def test_hashes_need_the_key(spark):
    import hashlib
    import hmac

    row = spark.createDataFrame([("Müller",), ("7",)], "p string")
    for key in (KEY, b"k" * 100):
        want = {p: hmac.new(key, p.encode(), hashlib.sha256).hexdigest() for p in ("Müller", "7")}
        assert {r.p: r.h for r in row.select("p", S.keyed(F.col("p"), key).alias("h")).collect()} == want
    a, b = (row.select(D.pseudonym(F.col("p"), k)).collect() for k in (KEY, b"another"))
    assert not {r[0] for r in a} & {r[0] for r in b}


def test_one_step(spark):
    """Chosen series, their studies and images change, others do not; repeated images stay equal, a second run changes nothing."""
    series = spark.createDataFrame([("s1", "t1"), ("s2", "t1"), ("s3", "t2")], "series_uid string, study_uid string")
    none = lambda df, **c: df.withColumns({k: F.lit(None).cast(t) for k, t in c.items()})
    series = none(series, deid_series_uid="string", deid_frame_uid="string", deid_series_date="date", status="string")
    studies = none(spark.createDataFrame([("t1",), ("t2",)], "study_uid string"), deid_study_uid="string", deid_study_date="date")
    images = none(spark.createDataFrame([("i1", "s1", "a"), ("i1", "s1", "b"), ("i2", "s1", "c"), ("i3", "s3", "d")], "sop_uid string, series_uid string, path string"), deid_sop_uid="string")
    exports = spark.createDataFrame([("s1", "FAILED"), ("s3", "SENT")], "series_uid string, transfer_status string")
    chosen = spark.createDataFrame([("s1", "s1.zip")], "series_uid string, archive string")
    out = D.deidentify(series, studies, images, exports, chosen, KEY)
    s = {r.series_uid: r for r in out["series"].collect()}
    t = {r.study_uid: r for r in out["studies"].collect()}
    i = {r.path: r.deid_sop_uid for r in out["instances"].collect()}
    assert s["s1"].status == "DEIDENTIFIED_SUCCESSFULLY" and s["s1"].deid_series_uid == f"{t['t1'].deid_study_uid}.1" and s["s2"].deid_series_uid is None and s["s3"].status is None
    assert s["s1"].deid_series_date == t["t1"].deid_study_date and t["t2"].deid_study_uid is None and out["instances"].columns == images.columns
    assert i["a"] == i["b"] != i["c"] and i["d"] is None and i["a"].startswith(s["s1"].deid_series_uid + ".")
    assert {(r.series_uid, r.transfer_status) for r in out["exports"].collect()} == {("s1", "PENDING"), ("s3", "SENT")}
    again = D.deidentify(series, out["studies"], images, exports, chosen, KEY)
    assert {r.study_uid: r for r in again["studies"].collect()} == t


def test_masked_tags_query(spark):
    rows = QUERIES["deid_masked_tags"](spark, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        tags = json.loads(r.tags)
        assert all(tags[t] == "#" for t in MASKED + FREE_TEXT) and tags["SeriesInstanceUID"] == r.series_uid and "(0009,0010)" not in tags


def test_every_listed_color(spark):
    want = {
        "Yellow": "255 255 0", "Cyan": "0 255 255", "Red": "255 0 0", "Green": "0 255 0", "Blue": "0 0 255", "Magenta": "255 0 255", "White": "255 255 255", "Black": "0 0 0", "Orange": "255 165 0",
        "Purple": "128 0 128", "Pink": "255 192 203", "Brown": "165 42 42", "Gray": "128 128 128", "Grey": "128 128 128", "Skin Rendering": "255 224 189", "Skin": "255 224 189",
        "Bone Rendering": "255 245 238", "Bone": "255 245 238", "Segment-Bone Rendering": "255 245 238", "opaque - PINK": "255 192 203", "FF0000": "255 0 0", "#00FFFF": "0 255 255", "008000": "0 128 0",
        "#123456": "18 52 86", "12345": "0 48 57", "RGB 255 0 0": "255 0 0", "RGB 256 0 0": "0 100 0", "InvalidColor": None, "": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in want], "c string").select("c", S.color(F.col("c")).alias("v")).collect()
    assert {r.c: r.v for r in got} == {k: v and v.replace(" ", "\\") for k, v in want.items()}
