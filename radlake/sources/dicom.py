"""DICOM files: headers as maps of tags, as typed rows, and structure sets with their nested sequences.

The data source ``dicom`` lists folders and reads headers in tasks, a few levels of
folders being listed when the scan is planned. Tasks read the first kilobytes of a
file, and more only if the header goes on. Data elements are explicit or implicit,
little- or big-endian, or deflated; texts are decoded by the character sets that
the file names. A sequence is a list of items, an item a dict.
"""

from __future__ import annotations

import base64
import codecs
import datetime as dt
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.tags import BY_NUMBER, NUMBERS, name_of, tag_id

#: Bytes read at first.
FIRST = 64 << 10
#: Representations with a length of four bytes, and those whose texts the character sets concern.
_LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UR", b"UT", b"UN", b"UV"}
_TEXTS = {"SH", "LO", "ST", "LT", "UT", "UC", "PN"}
_NUMBER = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}
UNDEFINED, ITEM, ITEM_END, SEQUENCE_END, PIXELS = 0xFFFFFFFF, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x7FE00010
IMPLICIT, BIG_ENDIAN, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
CHARACTER_SET = 0x00080005
#: Character sets by their registration number, and what an escape sequence calls in (fixed values).
CHARSETS = {
    "6": "latin-1", "100": "latin-1", "101": "iso8859-2", "109": "iso8859-3", "110": "iso8859-4", "144": "iso8859-5", "127": "iso8859-6", "126": "iso8859-7", "138": "iso8859-8", "148": "iso8859-9",
    "203": "iso8859-15", "166": "tis-620", "13": "shift_jis", "192": "utf-8", "87": "iso2022_jp", "159": "iso2022_jp_2", "149": "euc_kr", "58": "gb2312",
}
ESCAPES = {
    b"(B": "latin-1", b"-A": "latin-1", b"-B": "iso8859-2", b"-C": "iso8859-3", b"-D": "iso8859-4", b"-L": "iso8859-5", b"-G": "iso8859-6", b"-F": "iso8859-7", b"-H": "iso8859-8", b"-M": "iso8859-9",
    b"-b": "iso8859-15", b"-T": "tis-620", b"(J": "shift_jis", b")I": "shift_jis", b"$B": "iso2022_jp", b"$(D": "iso2022_jp_2", b"$)C": "euc_kr", b"$)A": "gb2312",
}
_ESCAPE = re.compile(rb"\x1b(\$\(D|\$\)[AC]|\$B|[-()][A-Za-z])")


class Encoding(NamedTuple):
    """Byte order, and the codec of texts before any escape sequence."""

    order: str = "<"
    codec: str = "utf-8"


class Short(Exception):
    """The header goes on behind the bytes at hand."""


def codec_of(named: str) -> str:
    """The codec of (0008,0005): its first value; a set that is not known, or none named, is read as UTF-8."""
    first = named.split("\\")[0].strip()
    if first in ("GB18030", "GBK"):
        return first.lower()
    found = re.fullmatch(r"ISO(?:_| 2022 )IR (\d+)", first)
    if found:
        return CHARSETS.get(found[1], "utf-8")
    return "latin-1" if "\\" in named else "utf-8"


def decoded(raw: bytes, codec: str) -> str:
    """A text with the escape sequences of ISO 2022; what no codec knows is replaced."""
    if b"\x1b" not in raw:
        return codecs.decode(raw, codec, "replace")
    parts = _ESCAPE.split(raw)
    out = [codecs.decode(parts[0], codec, "replace")]
    for escape, piece in zip(parts[1::2], parts[2::2]):
        own = ESCAPES.get(escape, codec)
        if own.startswith("iso2022"):
            piece = b"\x1b" + escape + piece
        out.append(codecs.decode(piece, own, "replace"))
    return "".join(out)


def text(raw: bytes, vr: str, encoding: Encoding = Encoding()) -> str:
    """A value as text; several values as a list."""
    if vr in _NUMBER:
        form = encoding.order + _NUMBER[vr]
        n = struct.calcsize(form)
        values = [str(struct.unpack_from(form, raw, k)[0]) for k in range(0, len(raw) - n + 1, n)]
    else:
        values = decoded(raw, encoding.codec if vr in _TEXTS or vr == "UN" else "utf-8").rstrip("\0 ").split("\\")
    return values[0] if len(values) == 1 else str(values) if values else ""


class Dictionary:
    """Names and representations of tags: those of functions/tags.py and further ones (number, keyword, representation)."""

    def __init__(self, more: Iterable[tuple[int, str, str]] = ()):
        self.tags = BY_NUMBER | {int(n): (k, vr) for n, k, vr in more}

    def vr(self, tag: int) -> str:
        return self.tags.get(tag, ("", "UN"))[1]

    def name(self, tag: int) -> str | None:
        return name_of(self.tags[tag][0]) if tag in self.tags else None


DEFAULT = Dictionary()


class Reader:
    """Data elements of a file of which ``data`` is the begin and ``size`` the length."""

    def __init__(self, data: bytes, size: int, explicit: bool, order: str = "<", dictionary: Dictionary = DEFAULT):
        self.data, self.size, self.explicit, self.order, self.dictionary = data, size, explicit, order, dictionary

    def need(self, end: int) -> None:
        if end > len(self.data):
            raise Short if len(self.data) < self.size else ValueError("an element ends behind the file")

    def number(self, form: str, at: int) -> int:
        return struct.unpack_from(self.order + form, self.data, at)[0]

    def head(self, at: int) -> tuple[int, str, int, int]:
        """Tag, representation, length and start of the value."""
        self.need(at + 8)
        group, element = self.number("H", at), self.number("H", at + 2)
        tag = group << 16 | element
        if not self.explicit or group == 0xFFFE:
            return tag, self.dictionary.vr(tag), self.number("I", at + 4), at + 8
        vr = self.data[at + 4 : at + 6]
        if vr in _LONG:
            self.need(at + 12)
            return tag, vr.decode("latin-1"), self.number("I", at + 8), at + 12
        return tag, vr.decode("latin-1"), self.number("H", at + 6), at + 8

    def items(self, at: int, length: int, codec: str) -> tuple[list[dict[int, tuple]], int]:
        """The items of a sequence and where it ends."""
        end, out = (at + length if length != UNDEFINED else None), []
        while end is None or at < end:
            tag, _, size, at = self.head(at)
            if tag == SEQUENCE_END:
                break
            if tag != ITEM:
                raise ValueError("no item in a sequence")
            item, at = self.elements(at, at + size if size != UNDEFINED else None, codec)
            out.append(item)
        return out, at

    def elements(self, at: int, end: int | None, codec: str = "utf-8") -> tuple[dict[int, tuple], int]:
        """Tag -> (representation, value, encoding) up to an end, an end of item, or the pixels. An item without character sets has those around it."""
        out: dict[int, tuple] = {}
        encoding = Encoding(self.order, codec)
        while at < (self.size if end is None else end):
            tag, vr, size, start = self.head(at)
            if tag == ITEM_END:
                return out, start
            if tag == PIXELS:
                return out, self.size
            if vr == "SQ" or (size == UNDEFINED and vr in ("UN", "OB", "OW")):
                value, at = self.items(start, size, encoding.codec)
                out[tag] = "SQ", value, encoding
            else:
                self.need(start + size)
                raw = self.data[start : start + size]
                if tag == CHARACTER_SET:
                    encoding = Encoding(self.order, codec_of(raw.decode("latin-1").strip("\0 ")))
                out[tag] = vr, raw, encoding
                at = start + size
        return out, at


def dataset(data: bytes, size: int | None = None, dictionary: Dictionary = DEFAULT) -> dict[int, tuple]:
    """All data elements before the pixels; raises Short, ValueError, struct.error or zlib.error."""
    size, at, explicit, order = len(data) if size is None else size, 0, False, "<"
    if data[128:132] == b"DICM":
        at, syntax = 132, IMPLICIT
        meta = Reader(data, size, True)
        while at + 8 <= size:
            meta.need(at + 2)
            if struct.unpack_from("<H", data, at)[0] != 2:
                break
            tag, vr, length, start = meta.head(at)
            meta.need(start + length)
            if tag == 0x00020010:
                syntax = text(data[start : start + length], "UI")
            at = start + length
        explicit, order = syntax != IMPLICIT, ">" if syntax == BIG_ENDIAN else "<"
        if syntax == DEFLATED:
            whole = len(data) >= size
            data, at = zlib.decompressobj(-15).decompress(data[at:]), 0
            size = len(data) if whole else 1 << 62  # its length is not known yet
    elif len(data) >= 8:
        explicit = data[4:6].isalpha() and data[4:6].isupper()
    return Reader(data, size, explicit, order, dictionary).elements(at, None)[0]


def value(items: dict[int, tuple], keyword: str) -> str | None:
    """The text of a tag, None if it is not there or a sequence."""
    found = items.get(NUMBERS[keyword])
    return None if found is None or found[0] == "SQ" else text(found[1], found[0], found[2])


def nested(items: dict[int, tuple], *keywords: str) -> Iterator[dict[int, tuple]]:
    """The items at the end of a path of sequences, in order."""
    if not keywords:
        yield items
        return
    found = items.get(NUMBERS[keywords[0]])
    for item in found[1] if found is not None and found[0] == "SQ" else []:
        yield from nested(item, *keywords[1:])


def header(data: bytes, size: int | None = None) -> dict[str, str] | None:
    """Tags by name and by number, sequences left out; None if it is no DICOM data. Private tags stand by number only."""
    return tag_map(dataset(data, size))


def tag_map(items: dict[int, tuple], dictionary: Dictionary = DEFAULT) -> dict[str, str] | None:
    tags: dict[str, str] = {}
    for tag, (vr, raw, encoding) in items.items():
        if vr != "SQ":
            shown = text(raw, vr, encoding)
            name = dictionary.name(tag)
            if name:
                tags[name] = shown
            tags[tag_id(tag)] = shown
    return tags or None


# --- datasets as JSON ---------------------------------------------------------------------

#: Representations whose value is one text, whatever it holds.
_SINGLE = {"ST", "LT", "UT", "UR"}
_BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}


def to_json(items: dict[int, tuple], dictionary: Dictionary = DEFAULT) -> dict[str, dict]:
    """Data elements in the JSON model of the standard: sequences nest, numbers of texts stay texts, binary values are base64."""
    out = {}
    for tag, (vr, raw, encoding) in sorted(items.items()):
        if vr == "UN":
            vr = dictionary.vr(tag)
        found: dict[str, object] = {"vr": vr}
        if vr == "SQ":
            found["Value"] = [to_json(i, dictionary) for i in raw] if isinstance(raw, list) else []
        elif vr in _BINARY:
            found["InlineBinary"] = base64.b64encode(raw).decode()
        elif vr in _NUMBER:
            form = encoding.order + _NUMBER[vr]
            n = struct.calcsize(form)
            found["Value"] = [struct.unpack_from(form, raw, k)[0] for k in range(0, len(raw) - n + 1, n)]
        elif vr == "AT":
            found["Value"] = ["%04X%04X" % struct.unpack_from(encoding.order + "HH", raw, k) for k in range(0, len(raw) - 3, 4)]
        else:
            shown = decoded(raw, encoding.codec if vr in _TEXTS else "utf-8").rstrip("\0 ")
            values = [shown] if vr in _SINGLE else shown.split("\\")
            found["Value"] = [{"Alphabetic": v} if vr == "PN" else v for v in values] if shown else []
        out[f"{tag:08X}"] = found
    return out


def encoded(data: dict[str, dict], explicit: bool = True) -> bytes:
    """Little-endian data elements of a dataset in JSON, texts as UTF-8. A value that is too long for its representation becomes UN."""
    out = []
    for number, found in sorted(data.items()):
        tag, vr, values = int(number, 16), found["vr"], found.get("Value") or []
        if vr == "SQ":
            items = [encoded(v, explicit) for v in values]
            raw = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in items)
        elif "InlineBinary" in found:
            raw = base64.b64decode(found["InlineBinary"])
        elif vr in _NUMBER:
            raw = b"".join(struct.pack("<" + _NUMBER[vr], v) for v in values)
        elif vr == "AT":
            raw = b"".join(struct.pack("<HH", int(v[:4], 16), int(v[4:], 16)) for v in values)
        else:
            raw = "\\".join("" if v is None else "=".join(filter(None, v.values())) if isinstance(v, dict) else str(v) for v in values).encode()
        raw += (b"\0" if vr in ("UI", "OB", "UN") else b" ") * (len(raw) % 2)
        head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
        if not explicit:
            out.append(head + struct.pack("<I", len(raw)) + raw)
            continue
        kind = vr.encode() if vr.encode() in _LONG or len(raw) < 0x10000 else b"UN"
        out.append(head + kind + (struct.pack("<HI", 0, len(raw)) if kind in _LONG else struct.pack("<H", len(raw))) + raw)
    return b"".join(out)


def file_of(data: dict[str, dict], explicit: bool = True) -> bytes:
    """A whole file of a dataset in JSON; its texts are UTF-8, and it says so if it needs to."""
    if not json.dumps(data, ensure_ascii=False).isascii():
        data = data | {f"{CHARACTER_SET:08X}": {"vr": "CS", "Value": ["ISO_IR 192"]}}
    first = lambda tag: (data.get(tag, {}).get("Value") or [""])[0]
    meta = {"00020002": {"vr": "UI", "Value": [first("00080016")]}, "00020003": {"vr": "UI", "Value": [first("00080018")]}, "00020010": {"vr": "UI", "Value": [IMPLICIT + (".1" if explicit else "")]}}
    return b"\0" * 128 + b"DICM" + encoded(meta) + encoded(data, explicit)


def replaced(data: dict[str, dict], new: dict[str, Callable[[str], str]]) -> dict[str, dict]:
    """A dataset with the values of some tags replaced wherever they stand in its tree."""
    out = {}
    for tag, found in data.items():
        if found["vr"] == "SQ":
            found = found | {"Value": [replaced(v, new) for v in found.get("Value") or []]}
        elif tag in new:
            found = found | {"Value": [new[tag](v) for v in found.get("Value") or []]}
        out[tag] = found
    return out


#: Tags of a frame of reference and of UIDs that refer to others (fixed values).
FRAMES, REFERENCES = ("00200052", "30060024"), ("00081155", "0020000E")


def reidentified_json(rows: DataFrame) -> DataFrame:
    """Rows with ``dataset`` (JSON) given back: ``fields`` (map of keyword to value) at the top, the ``frame`` and referred UIDs (map ``uids``) anywhere in the tree.

    A null or empty value changes nothing, a UID without a mapping stays. Other
    columns stay as they are.
    """
    others = [c for c in rows.columns if c not in ("dataset", "fields", "frame", "uids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shown, fields, frame, uids in zip(*(batch.column(len(others) + k).to_pylist() for k in range(4))):
                data, known = json.loads(shown), dict(uids or [])
                new: dict[str, Callable[[str], str]] = {t: lambda v, known=known: known.get(v, v) for t in REFERENCES}
                if frame:
                    new |= {t: lambda v, frame=frame: frame for t in FRAMES}
                data = replaced(data, new)
                for keyword, text_ in dict(fields or []).items():
                    if text_:
                        vr = DEFAULT.vr(NUMBERS[keyword])
                        data[f"{NUMBERS[keyword]:08X}"] = {"vr": vr, "Value": [{"Alphabetic": text_} if vr == "PN" else text_]}
                out.append(json.dumps(dict(sorted(data.items())), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(out, pa.string())], [*others, "dataset"])

    chosen = rows.select(*others, "dataset", F.col("fields").cast("map<string,string>"), F.col("frame").cast("string"), F.col("uids").cast("map<string,string>"))
    return chosen.mapInArrow(run, rows.select(*others, "dataset").schema)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def read_header(path: str, size: int, dictionary: Dictionary | None = None) -> dict[int, tuple]:
    """The data elements of a file; only as much is read as they need."""
    system, at = file_system(path)
    more = () if dictionary is None else (dictionary,)
    with system.open_input_file(at) as file:
        n = FIRST
        while True:
            data = file.read_at(min(n, size), 0)
            try:
                return dataset(data, size, *more)
            except Short:
                n *= 4


# --- the data source ----------------------------------------------------------------------

#: Folders that a scan is dealt out to at least, if there are as many; levels of folders listed for that; files of one folder in a task.
SPREAD, LEVELS, FLAT = 64, 3, 2000


@dataclass
class Folder(InputPartition):
    """A folder with all below it, or the share-th part of the files right in it."""

    path: str
    deep: bool
    share: int = 0
    shares: int = 1

    def files(self, system: fs.FileSystem) -> Iterator[fs.FileInfo]:
        for info in system.get_file_info(fs.FileSelector(self.path, recursive=self.deep)):
            if info.type == fs.FileType.File and "/_writing-" not in info.path and (self.shares == 1 or zlib.crc32(info.base_name.encode()) % self.shares == self.share):
                yield info


def folders(system: fs.FileSystem, base: str) -> list[Folder]:
    """What a scan is dealt out to: folders level by level until there are enough."""
    out, level = [], [base]
    for _ in range(LEVELS):
        below = []
        for folder in level:
            infos = system.get_file_info(fs.FileSelector(folder))
            files = sum(i.type == fs.FileType.File for i in infos)
            below += [i.path for i in infos if i.type == fs.FileType.Directory]
            shares = -(-files // FLAT)
            out += [Folder(folder, False, k, shares) for k in range(shares)]
        level = below
        if not level or len(out) + len(level) >= SPREAD:
            break
    return out + [Folder(f, True) for f in level]


def _images(items: dict[int, tuple], dictionary: Dictionary) -> tuple:
    return tuple(value(items, k) if f in DATES or f in ("modality", "sop_instance_uid") else value(items, k) or "" for f, k in FIELDS.items())


def _tags(items: dict[int, tuple], dictionary: Dictionary) -> tuple:
    return value(items, "Modality"), list((tag_map(items, dictionary) or {}).items()) or None


#: Types that path, mtime, size and modality are compared as, and the comparisons that are pushed.
_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b)}
_PUSHED = ("path", "mtime", "size", "modality")


class HeaderReader(DataSourceReader):
    """Headers of the files below a folder; filters on path, mtime and size leave files unread, those on modality leave rows unmade."""

    def __init__(self, options: dict[str, str]):
        self.path, self.content = options["path"], options.get("content", "tags")
        pairs = (e.split(":") for e in filter(None, options.get("dictionary", "").split(",")))
        self.dictionary = Dictionary((int(n, 16), k, vr) for n, k, vr in pairs)
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _COMPARED and name in _PUSHED:
                wanted = f.value if hasattr(f, "value") else tuple(f.value_set) if hasattr(f, "value_set") else f.values
                self.filters.append((name, type(f), wanted))
            else:
                yield f

    def passes(self, name: str, found: object) -> bool:
        return all(found is not None and _COMPARED[kind](found, wanted) for n, kind, wanted in self.filters if n == name)

    def partitions(self) -> list[Folder]:
        return folders(*file_system(self.path))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.path)
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else self.path.split("/", 1)[0]
        make, schema = CONTENTS[self.content]
        whole = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("error", pa.string()), *schema])
        at_modality = schema.names.index("modality")
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), whole)], schema=whole)
        for info in partition.files(system):
            path, mtime = prefix + info.path, info.mtime.astimezone(dt.timezone.utc)
            if not (self.passes("path", path) and self.passes("mtime", mtime) and self.passes("size", info.size)):
                continue
            try:
                items = read_header(path, info.size, self.dictionary) if self.content != "names" else {}
                made, error = make(items, self.dictionary), None
            except (struct.error, ValueError, IndexError, OSError, RecursionError, zlib.error) as e:
                made, error = (None,) * len(schema), f"{type(e).__name__}: {e}"
            if self.passes("modality", made[at_modality]):
                rows.append((path, mtime, info.size, error, *made))
            if len(rows) == 512:
                yield batch()
                rows = []
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has put in their places."""

    files: int


class FileWriter(DataSourceArrowWriter):
    """Rows (name, dataset) as files. A task writes all its files aside and then moves them to their names, so one that is killed and done again leaves none twice."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.explicit, self.overwrite = options["path"], options.get("implicit", "false") != "true", overwrite
        self.aside = f"_writing-{uuid.uuid4().hex}"
        if overwrite:
            system, base = file_system(self.path)
            if system.get_file_info(base).type != fs.FileType.NotFound:
                system.delete_dir_contents(base)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = file_system(self.path)
        own, names = f"{base}/{self.aside}/{uuid.uuid4().hex}", []
        system.create_dir(own)
        for batch in iterator:
            for name, shown in zip(batch.column("name").to_pylist(), batch.column("dataset").to_pylist()):
                with system.open_output_stream(f"{own}/{len(names)}") as out:
                    out.write(file_of(json.loads(shown), self.explicit))
                names.append(name)
        if len(set(names)) < len(names):
            raise ValueError("two files of one name")
        for k, name in enumerate(names):
            system.create_dir(f"{base}/{name}".rsplit("/", 1)[0])
            system.move(f"{own}/{k}", f"{base}/{name}")
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clean()
        if self.overwrite:
            system, base = file_system(self.path)
            there = sum(i.type == fs.FileType.File for i in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)))
            wanted = sum(m.files for m in messages if m is not None)
            if there != wanted:
                raise ValueError(f"{wanted} files were written, {there} are there: two tasks had files of one name")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clean()

    def clean(self) -> None:
        system, base = file_system(self.path)
        if system.get_file_info(f"{base}/{self.aside}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.aside}")


class DicomSource(DataSource):
    """``spark.read.format("dicom").option("content", "tags" | "images" | "structures" | "json").load(folder)``.

    path, mtime, size, error and, by content: modality and the map of tags, the
    fields of an image, the parts of a structure set, or the whole dataset before
    its pixels in JSON. Rows (name, dataset) are written as files, with option
    implicit in implicit representation. dictionary: further tags
    as ``GGGGEEEE:Keyword:VR,...``. headers() is the way to it: Spark keeps the
    reader of a DataFrame, so one that is used again must push a filter each time.
    """

    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return "path string, mtime timestamp, size long, error string, " + COLUMNS[self.options.get("content", "tags")]

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not {"name", "dataset"} <= set(schema.fieldNames()):
            raise ValueError("files are written from name and dataset")
        return FileWriter(dict(self.options), overwrite)


def headers(spark: SparkSession, path: str, content: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Rows of the data source; dictionary: further tags (number, keyword, vr), a few thousand at the most."""
    spark.dataSource.register(DicomSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if ":" not in path:
        path = f"file:{path}"
    reader = spark.read.format("dicom").option("content", content)
    if dictionary is not None:
        rows = dictionary.select("number", "keyword", "vr").limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError("a dictionary has 10,000 tags at the most")
        reader = reader.option("dictionary", ",".join(f"{r.number:08X}:{r.keyword}:{r.vr}" for r in rows))
    # a plan without any pushed filter would be given the reader of the plan before, with its filters: one is always there
    return reader.load(path).filter("size >= 0")


def scan(spark: SparkSession, path: str, dictionary: DataFrame | None = None) -> DataFrame:
    """path, mtime, size, status (success or error), tags of every file below a folder; sequences are left out, private tags stand by number."""
    rows = headers(spark, path, "tags", dictionary)
    return rows.select("path", "mtime", "size", F.when(F.col("tags").isNull(), "error").otherwise("success").alias("status"), "tags")


#: Fields of a scanned image and their tags (fixed values); those in DATES are null when missing, the others empty.
FIELDS = {
    "patient_id": "PatientID", "patient_name": "PatientName", "patient_gender": "PatientSex", "patient_birth_date": "PatientBirthDate", "study_instance_uid": "StudyInstanceUID", "study_date": "StudyDate",
    "study_time": "StudyTime", "study_description": "StudyDescription", "study_protocol": "ProtocolName", "accession_number": "AccessionNumber", "study_id": "StudyID", "series_description": "SeriesDescription",
    "modality": "Modality", "series_instance_uid": "SeriesInstanceUID", "series_date": "SeriesDate", "frame_of_reference_uid": "FrameOfReferenceUID", "sop_instance_uid": "SOPInstanceUID",
}
DATES = {"patient_birth_date", "study_date", "study_time", "series_date"}


def scan_images(spark: SparkSession, path: str, as_of: dt.datetime, since: dt.datetime | None = None, by_study_date: bool = False, exclude_localizers: bool = False) -> DataFrame:
    """Every file with status (success, skipped or error), reason, the 17 fields of its header, file_path and series_root_path.

    Files changed in the last ten minutes, or before ``since`` (if that is not
    in the future), are skipped unread; then a modality other than CT, MR and
    PT, a localizer, a study before ``since``. A file without SOP UID, and one
    that can't be read, is an error. Skipped and failed files have no fields.
    """
    stamp = lambda t: F.lit(t).cast("timestamp")
    late = F.col("mtime") > stamp(as_of - dt.timedelta(minutes=10))
    early = F.when(late, "recently_modified")
    images = headers(spark, path, "images")
    rows = images.filter(F.col("mtime") <= stamp(as_of - dt.timedelta(minutes=10)))
    if since is not None and since <= as_of:
        early = early.when(F.col("mtime") < stamp(since), "before_date_filter")
        rows = rows.filter(F.col("mtime") >= stamp(since))
    unread = headers(spark, path, "names").select("path", early.alias("_early"))
    day = F.when(F.col("study_date").rlike(r"^\d{8}$"), F.try_to_timestamp("study_date", F.lit("yyyyMMdd")))
    skipped = F.when(~F.coalesce(F.col("modality").isin("CT", "MR", "PT"), F.lit(False)), "unsupported_modality")
    failed = F.when(F.col("error").isNotNull(), "dicom_read_error").when(skipped.isNull() & (F.coalesce("sop_instance_uid", F.lit("")) == ""), "missing_sop_uid")
    if exclude_localizers:
        skipped = skipped.when(F.col("series_description").rlike(r"(?i)\b(topogram|scout|scanogram|surview)\b"), "localizer_series")
    if by_study_date and since is not None:
        skipped = skipped.when(F.coalesce(day < stamp(since), F.lit(False)), "study_date_before_filter")
    status = F.when(failed.isNotNull(), "error").when(skipped.isNotNull(), "skipped").otherwise("success")
    read_rows = rows.select("path", status.alias("status"), F.coalesce(failed, skipped).alias("reason"), *FIELDS)
    plain = unread.filter("_early IS NOT NULL").select("path", F.lit("skipped").alias("status"), F.col("_early").alias("reason"), *[F.lit(None).cast("string").alias(f) for f in FIELDS])
    good = F.col("status") == "success"
    out = read_rows.unionByName(plain)
    return out.select(
        F.col("path").alias("file_path"), F.when(good, F.regexp_replace("path", "/[^/]*$", "")).alias("series_root_path"), "status", "reason", *[F.when(good, F.col(f)).alias(f) for f in FIELDS]
    )


_ROI = pa.struct([("number", pa.int32()), ("name", pa.string())])
_CONTOUR = pa.struct([("roi_number", pa.int32()), ("color", pa.string()), ("points", pa.list_(pa.float64()))])
_OBSERVATION = pa.struct([("roi_number", pa.int32()), ("type", pa.string())])
STRUCTURES = pa.schema([
    ("sop_uid", pa.string()), ("series_uid", pa.string()), ("study_uid", pa.string()), ("patient_id", pa.string()), ("modality", pa.string()), ("label", pa.string()), ("referenced_series_uid", pa.string()),
    ("frame_uids", pa.list_(pa.string())), ("referenced_sop_uids", pa.list_(pa.string())), ("rois", pa.list_(_ROI)), ("contours", pa.list_(_CONTOUR)), ("observations", pa.list_(_OBSERVATION)),
])
STRUCTURES_SQL = (
    "sop_uid string, series_uid string, study_uid string, patient_id string, modality string, label string, referenced_series_uid string, frame_uids array<string>, referenced_sop_uids array<string>, "
    "rois array<struct<number:int,name:string>>, contours array<struct<roi_number:int,color:string,points:array<double>>>, observations array<struct<roi_number:int,type:string>>"
)


def _whole(shown: str | None) -> int | None:
    return int(shown) if shown and shown.strip().lstrip("+-").isdigit() else None


def _parts(item: dict[int, tuple], keyword: str) -> list[str]:
    vr, raw, _ = item.get(NUMBERS[keyword], (None, b"", None))
    return [] if vr in (None, "SQ") else [p.strip() for p in raw.decode("latin-1").rstrip("\0 ").split("\\") if p.strip()]


def structure_set(items: dict[int, tuple]) -> tuple:
    """The columns of STRUCTURES. The referenced series is the first one through the three nested sequences."""
    path = ("ReferencedFrameOfReferenceSequence", "RTReferencedStudySequence", "RTReferencedSeriesSequence")
    series = [u for x in nested(items, *path) if (u := value(x, "SeriesInstanceUID"))]
    images = [u for x in nested(items, *path, "ContourImageSequence") if (u := value(x, "ReferencedSOPInstanceUID"))]
    frames = [u for x in nested(items, path[0]) if (u := value(x, "FrameOfReferenceUID"))]
    rois = [{"number": _whole(value(x, "ROINumber")), "name": value(x, "ROIName")} for x in nested(items, "StructureSetROISequence")]
    contours = []
    for roi in nested(items, "ROIContourSequence"):
        number, color = _whole(value(roi, "ReferencedROINumber")), "\\".join(_parts(roi, "ROIDisplayColor")) or None
        contours += [{"roi_number": number, "color": color, "points": [float(p) for p in _parts(c, "ContourData")]} for c in nested(roi, "ContourSequence")]
    seen = [{"roi_number": _whole(value(x, "ReferencedROINumber")), "type": value(x, "RTROIInterpretedType")} for x in nested(items, "RTROIObservationsSequence")]
    plain = [value(items, k) for k in ("SOPInstanceUID", "SeriesInstanceUID", "StudyInstanceUID", "PatientID", "Modality", "StructureSetLabel")]
    return (*plain, series[0] if series else None, frames, images, rois, contours, seen)


def scan_structure_sets(spark: SparkSession, path: str) -> DataFrame:
    """Structure sets below a folder: path, mtime, size, error and the columns of STRUCTURES; other files have their modality only."""
    return headers(spark, path, "structures")


#: What a scan makes of a header, by content: function, Arrow and SQL columns. Names reads nothing.
CONTENTS: dict[str, tuple[Callable, pa.Schema]] = {
    "tags": (_tags, pa.schema([("modality", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])),
    "images": (_images, pa.schema([(f, pa.string()) for f in FIELDS])),
    "structures": (lambda items, dictionary: structure_set(items), STRUCTURES),
    "json": (lambda items, dictionary: (value(items, "Modality"), json.dumps(to_json(items, dictionary), ensure_ascii=False)), pa.schema([("modality", pa.string()), ("dataset", pa.string())])),
    "names": (lambda items, dictionary: (None,), pa.schema([("modality", pa.string())])),
}
COLUMNS = {"tags": "modality string, tags map<string,string>", "images": ", ".join(f"{f} string" for f in FIELDS), "structures": STRUCTURES_SQL, "json": "modality string, dataset string", "names": "modality string"}


def write(rows: DataFrame, path: str, implicit: bool = False, mode: str = "overwrite") -> None:
    """Rows (name, dataset) as DICOM files below a folder; overwrite empties it first."""
    rows.sparkSession.dataSource.register(DicomSource)
    rows.select("name", "dataset").write.format("dicom").option("implicit", str(implicit).lower()).mode(mode).save(path if ":" in path else f"file:{path}")


# --- structure sets in SQL ------------------------------------------------------------------

#: Rows of a structure set by the name of what they are.
PARTS = {
    "rois": StructType().add("number", "integer").add("name", "string"),
    "contours": StructType().add("roi_number", "integer").add("color", "string").add("kind", "string").add("points", ArrayType(DoubleType())),
    "observations": StructType().add("roi_number", "integer").add("type", "string"),
    "images": StructType().add("series_uid", "string").add("sop_uid", "string"),
}


def _each(data: dict, *path: str) -> Iterator[dict]:
    """The items at the end of a path of sequences (keywords), in order."""
    if not path:
        yield data
        return
    for item in data.get(f"{NUMBERS[path[0]]:08X}", {}).get("Value") or []:
        yield from _each(item, *path[1:])


def _first(data: dict, keyword: str) -> str | None:
    return (data.get(f"{NUMBERS[keyword]:08X}", {}).get("Value") or [None])[0]


def part_rows(data: dict, what: str) -> Iterator[tuple]:
    if what == "rois":
        yield from ((_whole(_first(x, "ROINumber")), _first(x, "ROIName")) for x in _each(data, "StructureSetROISequence"))
    elif what == "observations":
        yield from ((_whole(_first(x, "ReferencedROINumber")), _first(x, "RTROIInterpretedType")) for x in _each(data, "RTROIObservationsSequence"))
    elif what == "images":
        for x in _each(data, "ReferencedFrameOfReferenceSequence", "RTReferencedStudySequence", "RTReferencedSeriesSequence"):
            yield from ((_first(x, "SeriesInstanceUID"), _first(c, "ReferencedSOPInstanceUID")) for c in _each(x, "ContourImageSequence"))
    else:
        for x in _each(data, "ROIContourSequence"):
            color = "\\".join((x.get(f"{NUMBERS['ROIDisplayColor']:08X}", {}).get("Value")) or []) or None
            for c in _each(x, "ContourSequence"):
                points = [float(p) for p in c.get(f"{NUMBERS['ContourData']:08X}", {}).get("Value") or []]
                yield _whole(_first(x, "ReferencedROINumber")), color, _first(c, "ContourGeometricType"), points


class StructureParts:
    """``SELECT * FROM sets, LATERAL structure_parts(dataset, 'rois')``: rows of PARTS; the schema follows from the second argument."""

    @staticmethod
    def analyze(dataset: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if what.value not in PARTS:
            raise ValueError(f"structure_parts gives {', '.join(PARTS)}, not {what.value}")
        return AnalyzeResult(PARTS[what.value])

    def eval(self, dataset: str, what: str) -> Iterator[tuple]:
        if dataset:
            yield from part_rows(json.loads(dataset), what)


def register_functions(spark: SparkSession) -> None:
    """structure_parts for SQL."""
    spark.udtf.register("structure_parts", udtf(StructureParts))


# --- files for tests --------------------------------------------------------------------


def element(tag: int, vr: str, raw: bytes) -> bytes:
    """An explicit little-endian data element."""
    raw += (b"\0" if vr in ("UI", "OB") else b" ") * (len(raw) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode()
    return head + (struct.pack("<HI", 0, len(raw)) if vr.encode() in _LONG else struct.pack("<H", len(raw))) + raw


def sequence(tag: int, items: list[bytes], undefined: bool = False) -> bytes:
    """A sequence of items, each the bytes of its elements."""
    if not undefined:
        return element(tag, "SQ", b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in items))
    body = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, UNDEFINED) + i + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) for i in items)
    return struct.pack("<HH", tag >> 16, tag & 0xFFFF) + b"SQ" + struct.pack("<HI", 0, UNDEFINED) + body + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
