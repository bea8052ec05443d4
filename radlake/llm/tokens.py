"""Token ids: encoding, and a binary file of independent zstandard frames.

File layout, in ascending doc_id: data frames, one skippable frame with the
first and last doc_id of each data frame, and last the seek table of the public
zstd seekable format (sizes and an XXH64 checksum of every frame). A reader
takes the table from the end of the file and decompresses the frames it needs.
A data frame holds, little-endian: the number of documents (uint32), their ids
(int64), null flags (uint8) and lengths (uint32), then the token ids (uint32).
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, texts

#: Appended to every document.
END = struct.pack("<I", 1)
#: Fixed values of the zstd seekable format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 256 << 10
#: Tasks that read files back, at most.
READERS = 10_000
#: Words of a generation that an encoder remembers.
REMEMBERED = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to token ids with the tokenizers library, each new word encoded once.

    The vocabulary drops white space and never joins what it separates, so the
    ids of a text are those of its words in turn. New words of a text go to the
    library together. Words of letters, and maybe a full stop or comma behind,
    are one or two units of the vocabulary, whose last tokens are marked; other
    words are parted by a special token. Two generations of at most REMEMBERED
    words bound the memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.border, self.content = special[0][0], special[0][1].content
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        plain, units, other = [], [], []
        for w in words:
            c = w.decode()
            if c.isalpha():
                plain.append((w, c))
                units.append(1)
            elif c[-1] in ".," and c[:-1].isalpha():
                plain.append((w, c))
                units.append(2)
            else:
                other.append((w, c))
        if plain:
            ids = self._ids(" ".join([c for _, c in plain]))
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == sum(units):
                cut = ((ends[np.cumsum(units) - 1] + 1) * 4).tolist()
                raw = ids.tobytes()
                self.young.update(zip([w for w, _ in plain], [raw[a:b] for a, b in zip([0, *cut], cut)]))
            else:  # a letter that is taken apart when normalised
                other += plain
        if other:
            ids = self._ids(self.content.join([c for _, c in other]))
            cut = (np.flatnonzero(ids == self.border) * 4).tolist()
            raw = ids.tobytes()
            if len(cut) == len(other) - 1:
                self.young.update(zip([w for w, _ in other], [raw[a:b] for a, b in zip([0, *(x + 4 for x in cut)], [*cut, len(raw)])]))
            else:  # a word holds the special token itself
                self.young.update((w, self._ids(c).tobytes()) for w, c in other)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian uint32."""
        words = text.split()
        parts = list(map(self.young.get, words))
        if None in parts:
            holes = [k for k, part in enumerate(parts) if part is None]
            new = {words[k] for k in holes}
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, {}
            again = [w for w in new if w in self.old]
            self.young.update(zip(again, map(self.old.__getitem__, again)))
            new.difference_update(again)
            if new:
                self._learn(list(new))
            for k in holes:
                parts[k] = self.young[words[k]]
        return b"".join(parts)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def frame(docs: list[tuple[int | None, bytes]]) -> bytes:
    """A data frame, not compressed."""
    ids = np.array([d or 0 for d, _ in docs], "<i8")
    null = np.array([d is None for d, _ in docs], "u1")
    sizes = np.array([len(b) // 4 for _, b in docs], "<u4")
    return struct.pack("<I", len(docs)) + ids.tobytes() + null.tobytes() + sizes.tobytes() + b"".join(b for _, b in docs)


def unframe(raw: bytes) -> Iterator[tuple[int | None, bytes]]:
    (n,) = struct.unpack_from("<I", raw)
    ids = np.frombuffer(raw, "<i8", n, 4).tolist()
    null = np.frombuffer(raw, "u1", n, 4 + 8 * n).tolist()
    sizes = np.frombuffer(raw, "<u4", n, 4 + 9 * n).tolist()
    at = 4 + 13 * n
    for d, x, size in zip(ids, null, sizes):
        yield (None if x else d), raw[at : at + 4 * size]
        at += 4 * size


def write_file(out, docs: Iterable[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES) -> tuple[int, int]:
    """Writes (doc_id, ids) in the order given; returns documents and tokens."""
    compress = zstandard.ZstdCompressor(level=1).compress
    table, index, held, size, n_docs, n_tokens = [], [], [], 0, 0, 0

    def close():
        raw = frame(held)
        packed = compress(raw)
        table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        known = [d for d, _ in held if d is not None]
        index.append(struct.pack("<qqB", known[0] if known else 0, known[-1] if known else 0, (held[0][0] is None) + 2 * bool(known)))
        out.write(packed)
        held.clear()

    for doc in docs:
        held.append(doc)
        size += len(doc[1])
        n_docs += 1
        n_tokens += len(doc[1]) // 4
        if size >= frame_bytes:
            close()
            size = 0
    if held:
        close()
    body = b"".join(index)
    out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
    table.append((8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    body = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)
    return n_docs, n_tokens


def seek_table(file) -> list[tuple[int, int, int, int]]:
    """(offset, packed size, raw size, checksum) of every frame."""
    end = file.size()
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable zstd file")
    file.seek(end - 9 - 12 * n)
    flat = struct.unpack(f"<{3 * n}I", file.read(12 * n))
    out, at = [], 0
    for k in range(n):
        out.append((at, *flat[3 * k : 3 * k + 3]))
        at += flat[3 * k]
    return out


def read_frame(file, entry: tuple[int, int, int, int]) -> Iterator[tuple[int | None, bytes]]:
    at, packed, size, checksum = entry
    file.seek(at)
    raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
        raise ValueError(f"frame at {at} is damaged")
    return unframe(raw)


def read_file(file, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
    """All documents, or the wanted ones from just the frames that may hold them."""
    *frames, last = seek_table(file)
    file.seek(last[0] + 8)
    index = file.read(last[1] - 8)
    ordered = sorted(wanted or ())
    for k, entry in enumerate(frames):
        if wanted is not None:
            low, high, kinds = struct.unpack_from("<qqB", index, 17 * k)
            i = np.searchsorted(ordered, low)
            if not kinds & 2 or i == len(ordered) or ordered[i] > high:
                continue
        for doc_id, ids in read_frame(file, entry):
            if wanted is None or doc_id in wanted:
                yield doc_id, ids


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer: str | None = None) -> DataFrame:
    """Encodes whole texts into files; returns (path, part, n_docs, n_tokens), saved.

    Documents are range-partitioned by doc_id (null first) and a hash of the text,
    so that rows of one id or none are no single file, and sorted; each task writes a file of its own name, and only files in the saved manifest count,
    so a task that runs twice leaves no double.
    """
    path, folder = tokenizer or default_tokenizer(), scratch.uri("tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)

        def encoded():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                    yield doc_id, encoder.encode(text) + END

        docs = encoded()
        first = next(docs, None)
        if first is None:
            return
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.zst"
        with system.open_output_stream(f"{at}/{name}", compression=None) as out:
            n_docs, n_tokens = write_file(out, (x for some in ([first], docs) for x in some))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": pa.array([int(name[:8])], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    order = ["doc_id", "_hash"]
    hashed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"))
    ordered = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return scratch.save(ordered.mapInArrow(write, "path string, part int, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest.

    start counts the ids of all documents before, in file order. ``wanted``: a
    list of doc_ids; only the frames that may hold them are read.
    """
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_file(at) as file:
                    for doc_id, ids in read_file(file, some):
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                if rows:
                    doc_id, begin, n, crc = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_id, begin, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number of partitions, so that the few bytes of paths are not put together in one task
    n = max(1, min(READERS, manifest.count()))
    files = manifest.select("path", before.alias("before")).repartition(n, "path")
    out = files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out if wanted is None else out.drop("start")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes, writes and reads back whole documents: one row per document.

    Null text is empty (only the end id); null doc_id comes first; rows with the
    same doc_id stay apart, ordered by a hash of the text; an empty table gives no file and no
    row; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, scratch, tokenizer))
