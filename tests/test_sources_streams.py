"""Sources on files made here, streams against batch, and the registered queries."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from radlake import queries
from radlake.operators import catalog as C
from radlake.functions.tags import DICTIONARY
from radlake.sources import dicom, files
from radlake.streaming import completion

SF = "/root/testdata/sf0.001"


def dicom_file(explicit=True, **tags):
    by_name = {n: (t, v) for t, n, v in DICTIONARY}
    body = b""
    for name, value in sorted(tags.items(), key=lambda x: by_name[x[0]][0]):
        tag, vr = by_name[name]
        raw = value if isinstance(value, bytes) else value.encode()
        if explicit:
            body += dicom.element(tag, vr, raw)
        else:
            raw += b" " * (len(raw) % 2)
            body += (tag >> 16).to_bytes(2, "little") + (tag & 0xFFFF).to_bytes(2, "little") + len(raw).to_bytes(4, "little") + raw
    syntax = "1.2.840.10008.1.2.1" if explicit else "1.2.840.10008.1.2"
    return b"\0" * 128 + b"DICM" + dicom.element(0x00020010, "UI", syntax.encode()) + body


@pytest.mark.parametrize("explicit", [True, False])
def test_dicom_headers(spark, tmp_path, explicit):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "1").write_bytes(dicom_file(explicit, Modality="CT", PatientID="CT12345", SliceThickness="2.5\\3", Rows=(512).to_bytes(2, "little")))
    (tmp_path / "junk.txt").write_bytes(b"no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in dicom.scan(spark, str(tmp_path)).collect()}
    tags = rows["1"].tags
    assert rows["1"].status == "success" and rows["junk.txt"].status == "error"
    assert tags["Modality"] == tags["(0008,0060)"] == "CT" and tags["Patient ID"] == "CT12345" and tags["Slice Thickness"] == "['2.5', '3']" and tags["Rows"] == "512"
    assert files.listing(spark, str(tmp_path)).count() == 2


def test_headers_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Only as much of a file is read as its header needs; what is cut off is an error."""
    read = []
    whole = dicom_file(True, Modality="CT", PatientID="7", StudyDescription="x" * 60) + dicom.element(dicom.PIXELS, "OW", b"\0" * 500_000)
    (tmp_path / "big").write_bytes(whole)
    (tmp_path / "cut").write_bytes(whole[:200])
    assert dicom.value(dicom.read_header(f"file:{tmp_path}/big", len(whole)), "PatientID") == "7"
    monkeypatch.setattr(dicom, "FIRST", 64)
    assert dicom.value(dicom.read_header(f"file:{tmp_path}/big", len(whole)), "Modality") == "CT"
    with pytest.raises(ValueError):
        dicom.read_header(f"file:{tmp_path}/cut", 200)
    data = dicom.dataset

    def counted(part, size=None):
        read.append(len(part))
        return data(part, size)

    monkeypatch.setattr(dicom, "dataset", counted)
    dicom.read_header(f"file:{tmp_path}/big", len(whole))
    assert max(read) < 2000


@pytest.mark.parametrize("undefined", [True, False])
def test_nested_sequences(undefined):
    from radlake.functions.tags import NUMBERS as n

    inner = dicom.sequence(n["RTReferencedSeriesSequence"], [dicom.element(n["SeriesInstanceUID"], "UI", b"1.2.3"), dicom.element(n["SeriesInstanceUID"], "UI", b"4.5.6")], undefined)
    frames = dicom.sequence(n["ReferencedFrameOfReferenceSequence"], [dicom.sequence(n["RTReferencedStudySequence"], [b"", inner], undefined), b""], not undefined)
    items = dicom.dataset(dicom_file(True, Modality="RTSTRUCT") + frames + dicom.element(n["ReviewerName"], "PN", b"R"))
    assert dicom.structure_set(items)[6] == "1.2.3" and dicom.value(items, "ReviewerName") == "R" and dicom.value(items, "ReferencedFrameOfReferenceSequence") is None
    assert [dicom.value(x, "SeriesInstanceUID") for x in dicom.nested(items, "ReferencedFrameOfReferenceSequence", "RTReferencedStudySequence", "RTReferencedSeriesSequence")] == ["1.2.3", "4.5.6"]


def with_charset(charset: bytes, name: bytes, **more) -> bytes:
    return dicom_file(True, PatientName=name, **more)[:132] + dicom.element(0x00020010, "UI", b"1.2.840.10008.1.2.1") + dicom.element(0x00080005, "CS", charset) + dicom.element(0x00100010, "PN", name)


@pytest.mark.parametrize("charset,name,shown", [
    (b"ISO_IR 100", "Müller^Jürgen".encode("latin-1"), "Müller^Jürgen"),
    (b"ISO_IR 144", "Люкceмбypг".encode("iso8859-5"), "Люкceмбypг"),
    (b"ISO_IR 192", "Wang^XiaoDong=王^小东".encode(), "Wang^XiaoDong=王^小东"),
    (b"GB18030", "Wang=王^小东".encode("gb18030"), "Wang=王^小东"),
    (b"\\ISO 2022 IR 87", b"Yamada^Tarou=\x1b$B;3ED\x1b(B^\x1b$BB@O:\x1b(B=\x1b$B$d$^$@\x1b(B^\x1b$B$?$m$&\x1b(B", "Yamada^Tarou=山田^太郎=やまだ^たろう"),
    (b"\\ISO 2022 IR 149", b"Hong^Gildong=\x1b$)C\xfb\xf3^\x1b$)C\xd1\xce\xd4\xd7", "Hong^Gildong=洪^吉洞"),
    (b"ISO 2022 IR 100\\ISO 2022 IR 144", "Müller".encode("latin-1") + b"=\x1b-L" + "Миша".encode("iso8859-5"), "Müller=Миша"),
    (b"ISO_IR 999", "é".encode(), "é"),
    (b"", "é".encode(), "é"),
])
def test_character_sets(charset, name, shown):
    assert dicom.value(dicom.dataset(with_charset(charset, name)), "PatientName") == shown


def test_items_have_the_character_set_around_them():
    from radlake.functions.tags import NUMBERS as n

    rois = [dicom.element(n["ROIName"], "LO", "Hüfte".encode("latin-1")), dicom.element(0x00080005, "CS", b"ISO_IR 192") + dicom.element(n["ROIName"], "LO", "Hüfte".encode())]
    data = with_charset(b"ISO_IR 100", "Jürgen".encode("latin-1")) + dicom.sequence(n["StructureSetROISequence"], rois)
    items = dicom.dataset(data)
    assert [dicom.value(x, "ROIName") for x in dicom.nested(items, "StructureSetROISequence")] == ["Hüfte", "Hüfte"] and dicom.value(items, "PatientName") == "Jürgen"


def test_other_transfer_syntaxes():
    import struct
    import zlib

    def big(tag, vr, raw):
        return struct.pack(">HH", tag >> 16, tag & 0xFFFF) + vr.encode() + struct.pack(">H", len(raw)) + raw

    head = lambda syntax: b"\0" * 128 + b"DICM" + dicom.element(0x00020010, "UI", syntax.encode())
    items = dicom.dataset(head(dicom.BIG_ENDIAN) + big(0x00080060, "CS", b"CT") + big(0x00280010, "US", b"\2\0"))
    assert dicom.value(items, "Modality") == "CT" and dicom.value(items, "Rows") == "512"
    body = dicom.element(0x00080060, "CS", b"MR") + dicom.element(0x00104000, "LT", bytes(range(32, 127)) * 40) + dicom.element(dicom.PIXELS, "OW", b"\1\7" * 5000)
    packed = zlib.compressobj(wbits=-15)
    data = head(dicom.DEFLATED) + packed.compress(body) + packed.flush()
    items = dicom.dataset(data)
    assert dicom.value(items, "Modality") == "MR" and dicom.value(items, "PatientComments").startswith("[' !") and 0x7FE00010 not in items
    with pytest.raises(dicom.Short):
        dicom.dataset(data[:170], len(data))


def test_filters_are_pushed_to_the_source(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}" / f"{k}.dcm").write_bytes(dicom_file(True, Modality="CT" if k % 2 else "MR", PatientID=str(k)))
    (tmp_path / "d0" / "junk").write_bytes(b"no")
    rows = dicom.headers(spark, str(tmp_path), "tags")
    late = rows.filter((F.col("mtime") > F.lit("2100-01-01").cast("timestamp")) & (F.col("size") > 3))
    assert late.count() == 0 and rows.filter("modality = 'CT'").count() == 3 and rows.filter("modality IN ('CT', 'MR') AND size > 0").count() == 6
    assert rows.filter(F.col("path").startswith(f"file:{tmp_path}/d1")).count() == 2 and rows.filter("error IS NOT NULL OR tags IS NULL").count() == 1
    reader = dicom.HeaderReader({"path": f"file:{tmp_path}", "content": "tags"})
    left = list(reader.pushFilters([dicom.EqualTo(("modality",), "CT"), dicom.GreaterThan(("size",), 10**9), dicom.EqualTo(("error",), "x")]))
    assert [f.attribute for f in left] == [("error",)]
    monkeypatch.setattr(dicom, "read_header", lambda *a: (_ for _ in ()).throw(AssertionError("a file was read")))
    assert not [b for part in reader.partitions() for b in reader.read(part)]
    assert {(p.path.rsplit("/", 1)[1], p.deep) for p in reader.partitions()} == {("d0", False), ("d1", False), ("d2", False)}


def test_folders_are_dealt_out(tmp_path, monkeypatch):
    from pyarrow import fs

    for k in range(90):
        at = tmp_path / f"a{k % 5}" / f"b{k % 15}" / "c"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k}").write_bytes(b"x")
        (tmp_path / f"top{k}").write_bytes(b"x")
    monkeypatch.setattr(dicom, "FLAT", 40)
    monkeypatch.setattr(dicom, "SPREAD", 10)
    parts = dicom.folders(fs.LocalFileSystem(), str(tmp_path))
    found = [i.path for p in parts for i in p.files(fs.LocalFileSystem())]
    assert len(found) == len(set(found)) == 180 and sum(p.shares == 3 for p in parts) == 3 and sum(p.deep for p in parts) == 15


def test_a_dictionary_of_further_tags(spark, tmp_path):
    (tmp_path / "a").write_bytes(dicom_file(False, Modality="CT") + (0x0018).to_bytes(2, "little") + (0x9305).to_bytes(2, "little") + (8).to_bytes(4, "little") + bytes(6) + b"\xe0\x3f")
    more = spark.createDataFrame([(0x00189305, "RevolutionTime", "FD")], "number long, keyword string, vr string")
    plain, known = (dicom.scan(spark, str(tmp_path), d).first().tags for d in (None, more))
    assert known["Revolution Time"] == known["(0018,9305)"] == "0.5" and "Revolution Time" not in plain and plain["Modality"] == "CT"


@pytest.mark.parametrize("implicit", [False, True])
def test_datasets_there_and_back(spark, tmp_path, implicit):
    """What is written is what was read: nested sequences, several values, numbers, binary, names in other scripts."""
    import json

    data = {
        "00080005": {"vr": "CS", "Value": ["ISO_IR 192"]}, "00080016": {"vr": "UI", "Value": ["1.2.840.10008.5.1.4.1.1.481.3"]}, "00080018": {"vr": "UI", "Value": ["1.2.3"]}, "00080060": {"vr": "CS", "Value": ["RTSTRUCT"]},
        "00100010": {"vr": "PN", "Value": [{"Alphabetic": "Müller^Jürgen=王^小东"}]}, "00100020": {"vr": "LO", "Value": []}, "00104000": {"vr": "LT", "Value": ["a\\b"]}, "00180050": {"vr": "DS", "Value": ["2.5", "3"]},
        "00280010": {"vr": "US", "Value": [512, 3]}, "00091001": {"vr": "UN", "InlineBinary": "AAEC/w=="}, "00189305": {"vr": "FD" if not implicit else "UN"} | ({"Value": [0.5]} if not implicit else {"InlineBinary": "AAAAAAAA4D8="}),
        "30060010": {"vr": "SQ", "Value": [{"00200052": {"vr": "UI", "Value": ["9.9"]}, "30060012": {"vr": "SQ", "Value": [{}, {"30060014": {"vr": "SQ", "Value": [{"0020000E": {"vr": "UI", "Value": ["4.5"]}}]}}]}}]},
        "30060039": {"vr": "SQ", "Value": [{"30060040": {"vr": "SQ", "Value": [{"30060050": {"vr": "DS", "Value": [str(k) for k in range(20000)]}}]}}]}, "30060080": {"vr": "SQ", "Value": []},
    }
    rows = spark.createDataFrame([(f"d{k % 2}/{k}.dcm", json.dumps(data | {"00100020": {"vr": "LO", "Value": [str(k)]}}, ensure_ascii=False)) for k in range(7)], "name string, dataset string")
    at = str(tmp_path / "out")
    for _ in range(2):  # the second time over the first
        dicom.write(rows.repartition(3), at, implicit)
    found = {r.path.split("/out/")[1]: json.loads(r.dataset) for r in dicom.headers(spark, at, "json").collect()}
    assert found == {f"d{k % 2}/{k}.dcm": data | {"00100020": {"vr": "LO", "Value": [str(k)]}} for k in range(7)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d0", "d1"]
    new = {"00200052": lambda v: "F", "0020000E": lambda v: "S"}
    assert json.dumps(dicom.replaced(data, new)).count('"F"') == 1 and json.dumps(dicom.replaced(data, new)).count('"S"') == 1


def test_a_killed_task_leaves_no_double(tmp_path):
    """A task that dies between its writes, one that runs twice, and two rows of one name."""
    import json

    import pyarrow as pa

    batch = lambda *names: pa.RecordBatch.from_pydict({"name": list(names), "dataset": [json.dumps({"00080060": {"vr": "CS", "Value": ["CT"]}})] * len(names)})
    writer = dicom.FileWriter({"path": f"file:{tmp_path}/x"}, True)

    def dies():
        yield batch("a", "b")
        raise OSError("killed")

    with pytest.raises(OSError):
        writer.write(dies())
    done = [writer.write(iter([batch("a", "b"), batch("c")])), writer.write(iter([batch("d")]))]
    writer.write(iter([batch("a", "b"), batch("c")]))  # of which nobody hears
    assert list(dicom.Folder(f"{tmp_path}/x", True).files(__import__("pyarrow").fs.LocalFileSystem())).__len__() == 4
    writer.commit(done)
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="one name"):
        writer.write(iter([batch("e", "e")]))
    again = dicom.FileWriter({"path": f"file:{tmp_path}/x"}, True)
    with pytest.raises(ValueError, match="two tasks"):
        again.commit([again.write(iter([batch("e")])), again.write(iter([batch("e")]))])


def test_parts_by_name(spark):
    dicom.register_functions(spark)
    with pytest.raises(Exception, match="not colours"):
        spark.sql("SELECT * FROM structure_parts('{}', 'colours')").collect()
    assert spark.sql("SELECT * FROM structure_parts(NULL, 'rois')").columns == ["number", "name"] and spark.sql("SELECT * FROM structure_parts('{}', 'images')").count() == 0


def test_scan_skips_and_fails(spark, tmp_path):
    now = dt.datetime.now()
    for name, content in {"ok": dicom_file(True, Modality="MR", SOPInstanceUID="1.2", SeriesInstanceUID="3"), "us": dicom_file(True, Modality="US", SOPInstanceUID="1"), "nouid": dicom_file(True, Modality="CT"), "junk": b"DICM? no"}.items():
        (tmp_path / name).write_bytes(content)
    of = lambda **kw: {r.file_path.rsplit("/", 1)[1]: (r.status, r.reason) for r in dicom.scan_images(spark, str(tmp_path), **kw).collect()}
    late = of(as_of=now + dt.timedelta(hours=1))
    assert late["ok"] == ("success", None) and late["us"] == ("skipped", "unsupported_modality") and late["nouid"] == ("error", "missing_sop_uid") and late["junk"][1] in ("dicom_read_error", "unsupported_modality")
    assert set(of(as_of=now + dt.timedelta(minutes=1)).values()) == {("skipped", "recently_modified")}
    assert set(of(as_of=now + dt.timedelta(days=9), since=now + dt.timedelta(days=2)).values()) == {("skipped", "before_date_filter")}
    row = dicom.scan_images(spark, str(tmp_path), now + dt.timedelta(hours=1)).filter("status = 'success'").first()
    assert row.patient_id == "" and row.study_date is None and row.series_instance_uid == "3" and row.series_root_path.endswith(tmp_path.name)


def test_a_registered_parser(spark, monkeypatch):
    from radlake import registry

    monkeypatch.setattr(registry, "PARSERS", registry.PARSERS)
    docs = spark.createDataFrame([("a", "<Mine><n>x</n></Mine>"), ("b", "<?xml version='1.0'?><Protocol><Structure ID='1' Name='H'/></Protocol>")], "f string, xml string")
    registry.register_parser("Mine")(lambda d: files.structures_of(d.withColumn("xml", F.lit("<X><Structure Name='m'/></X>"))))
    try:
        assert {(r.f, r.name, r.type, r.color) for r in files.parse_templates(docs).collect()} == {("a", "m", None, None), ("b", "1", None, None)}
    finally:
        del registry.PARSERS["Mine"]


def test_stream_release_and_repeats(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, t(1), 1, "a", "s1", "/1", False), (2, t(2), 1, "a", "s1", "/2", False), (3, t(3), 1, "a", "s2", "/3", False), (4, t(4), 1, None, None, None, True), (5, t(5), 1, "a", "s3", "/4", False), (6, t(6), 2, "b", "s4", "/5", False)]
    schema = "event_id long, ts timestamp, ae long, series_uid string, sop_uid string, path string, released boolean"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    writer = completion.completed_series(stream).writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    completion.run_to_end(spark, writer)
    got = [(r.ae, r.series_uid, r.n, r.sop_uids, r.paths) for r in spark.table("done").collect()]
    assert got == [(1, "a", 2, ["s1", "s2"], ["/1", "/3"])]  # the rest is open


def received(spark, at, rows):
    """A stream of rows, one file for each list: (event_id, second, ae, series, sop, released)."""
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    schema = "event_id long, ts timestamp, ae long, series_uid string, sop_uid string, path string, released boolean"
    for k, part in enumerate(rows):
        df = spark.createDataFrame([(e, t(n), ae, s, sop, f"/{e}", gone) for e, n, ae, s, sop, gone in part], schema)
        df.coalesce(1).write.mode("append").parquet(str(at / "in"))
        if k:
            import time

            time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at / "in"))


def finished(spark, stream, at, name):
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(at / name))
    completion.run_to_end(spark, writer)
    return [(r.ae, r.series_uid, r.n, r.sop_uids, r.paths, r.late) for r in spark.table(name).collect()]


def test_repeats_and_late_files_over_batches(spark, tmp_path):
    batches = [
        [(1, 1, 1, "a", "x", False), (2, 2, 1, "a", "x", False)],
        [(4, 4, 1, "b", "z", False), (3, 3, 1, "a", "y", False)],  # in no order
        [(5, 5, 1, "a", "late", False), (6, 6, 1, "b", "z", False), (7, 7, 1, "a", "late2", False)],
        [(8, 8, 1, None, None, True), (9, 9, 2, "a", "q", False)],  # another sender's series of that name is open
    ]
    stream = received(spark, tmp_path, batches)
    a = (1, "a", 3, ["x", "y"], ["/1", "/2", "/3"], False)
    assert finished(spark, completion.series_stream(stream, drop_late=True), tmp_path, "dropped") == [a, (1, "a", 2, [], [], True), (1, "b", 2, ["z"], ["/4", "/6"], False)]
    got = finished(spark, completion.series_stream(stream), tmp_path, "taken")
    assert got == [a, (1, "b", 1, ["z"], ["/4"], False), (1, "a", 1, ["late"], ["/5"], False), (1, "b", 1, ["z"], ["/6"], False), (1, "a", 1, ["late2"], ["/7"], False)]
    assert finished(spark, completion.series_stream(stream, count_repeats=False), tmp_path, "once")[0] == (1, "a", 2, ["x", "y"], ["/1", "/3"], False)


def test_a_silent_sender(spark, tmp_path):
    """The timer ends the series of a sender that says nothing more."""
    import time

    stream = received(spark, tmp_path, [[(1, 1, 1, "a", "x", False)]])
    q = completion.series_stream(stream, quiet_ms=500).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "silent")).start()
    try:
        end = time.time() + 60
        while not spark.table("silent").count() and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert [(r.series_uid, r.n) for r in spark.table("silent").collect()] == [("a", 1)]


def test_state_is_written_by_row(spark, tmp_path):
    """A long series over many batches: state rows updated in a batch don't grow with the series."""
    stream = received(spark, tmp_path, [[(10 * k + n, 10 * k + n, 1, "a", f"{k}.{n}", False) for n in range(10)] for k in range(6)])
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = completion.series_stream(stream).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    updated = [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.numInputRows]
    assert len(updated) == 6 and max(updated[1:]) <= updated[1] + 2


def test_an_ingest_that_is_stopped(spark, tmp_path):
    from radlake.streaming import ingest

    for k in range(5):
        spark.createDataFrame([(f"s{n}", k) for n in range(k, k + 3)], "sop string, size int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = []

    def seen(n):
        done.append(n)
        if done == [0, 1]:
            raise RuntimeError("stopped")

    where = (str(tmp_path / "in"), "sop string, size int", str(tmp_path / "out"), str(tmp_path / "c"), 1)
    with pytest.raises(Exception, match="stopped"):
        ingest.ingest(spark, *where, seen=seen).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    ingest.ingest(spark, *where, seen=seen).awaitTermination()
    assert done == [0, 1, 1, 2, 3, 4]  # the second one again
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 15 and ingest.catalog(spark, "sop string, size int", str(tmp_path / "out"), ["sop"], ["size"]).count() == 7


def test_resuming_a_run(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "directory string")
    at = lambda h: F.lit(dt.datetime(2024, 1, 1, h))
    of = lambda last, saved: sorted(r.directory for r in C.resume_after(d, last, at(saved), at(9)).collect())
    assert of("b", 6) == ["c"] and of("b", 4) == ["a", "b", "c"] and of(None, 8) == ["a", "b", "c"]


def test_xml_templates_and_catalog(spark, tmp_path):
    xml = "<StructureTemplate><Structures><Structure ID='1' Name='Heart'><Identification><VolumeType>Organ</VolumeType></Identification><ColorAndStyle>red</ColorAndStyle></Structure></Structures></StructureTemplate>"
    got = files.structures(spark.createDataFrame([("f", xml)], "path string, xml string")).collect()
    assert [(r.path, r.position, r.id, r.name, r.volume_type, r.color_string) for r in got] == [("f", 0, "1", "1", "Organ", "red")]
    body = '[{"id": "1", "name": "m", "modelmap": [{"map_id": "7", "major_category": "x"}, {"map_id": "8"}]}]'
    rows = files.model_catalog(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.map_id, r.model_name) for r in rows] == [("7", "m"), ("8", "m")]
    (tmp_path / "a.log").write_text("One\ntwo ERROR\n")
    assert files.log_search(spark, str(tmp_path), "error").collect()[0].value == "two ERROR"


def test_templates_by_the_rules_of_xml(spark):
    """Expected rows as the studied parser gives them: the ID is the name, elements lie anywhere below, comments are none."""
    docs = {
        "comment": "<!-- <Other> --><StructureTemplate><Structure ID='A' Name='B'/></StructureTemplate>",
        "declared": "\ufeff<?xml version='1.0' encoding='UTF-8'?>\n<!DOCTYPE Protocol [<!ENTITY x 'y'>]>\n<Protocol><a><b><Structure Name='&x;1'><c><VolumeType>GTV</VolumeType></c><d><ColorAndStyle>RGB 1 2 3</ColorAndStyle></d></Structure></b></a></Protocol>",
        "quotes": "<Protocol><Structure ID=\"a > b\" Name='/>'><VolumeType></VolumeType></Structure><Structure ID='second'/></Protocol>",
        "cdata": "<Protocol><note><![CDATA[<Structure ID='no'/>]]></note><Structure Name='yes'/></Protocol>",
        "broken": "<Protocol><Structure ID='x'></Protocol>", "none": "<Protocol/>", "other": "<Plan><Structure ID='x'/></Plan>", "empty": "", "null": None,
    }
    df = spark.createDataFrame(list(docs.items()), "f string, xml string")
    got = {(r.f, r.position): (r.id, r.name, r.volume_type, r.type, r.color) for r in files.parse_templates(df).collect()}
    assert got == {
        ("comment", 0): ("A", "A", None, None, None), ("declared", 0): (None, "y1", "GTV", "GTV", "1\\2\\3"), ("quotes", 0): ("a > b", "a > b", None, None, None),
        ("quotes", 1): ("second", "second", None, None, None), ("cdata", 0): (None, "yes", None, None, None),
    }
    assert {r.f: r.error for r in files.template_errors(df).collect()} == {"broken": "invalid", "none": "no_structures", "other": "unknown", "empty": "invalid", "null": "invalid"}


def test_stream_completion_equals_islands(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ae"), F.col("event_type").alias("series_uid"))
    e.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = completion.completed_series(stream).writeStream.outputMode("append").format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert q.awaitTermination(120)
    got = spark.table("done").toPandas()
    batch = C.change_runs(e, "ae", "series_uid", ["ts", "event_id"]).toPandas()
    last = batch.groupby("ae").run.transform("max") == batch.run
    key = ["ae", "series_uid", "n", "first", "last"]
    want = batch[~last][key].sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want, check_dtype=False)


def test_stream_snapshots_and_repeats(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 5), 1), (1, dt.datetime(2024, 1, 1, 0, 6), 1), (2, dt.datetime(2024, 1, 1, 0, 40), 1)]
    df = spark.createDataFrame(rows, "sop long, ts timestamp, ae long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("snap", completion.snapshots(stream, "ts", "ae"), "complete"), ("once", completion.without_repeats(stream, "sop", "ts"), "append"), ("sums", completion.counters(stream, "ae", "sop"), "complete")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("snap").collect()) == [1, 2]
    assert sorted(r.sop for r in spark.table("once").collect()) == [1, 2]
    assert spark.table("sums").first().files == 3


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = sorted(got.columns)
    by = lambda d: d[key].sort_values(key, key=lambda s: s.astype(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(by(got), by(want), check_dtype=False, rtol=1e-9)
