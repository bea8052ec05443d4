"""Exact substring deduplication by the common-prefix interval tree of suffix arrays.

A repeat of LEAST bytes must meet itself in one task, so every LEAST-byte window
is owned by its minimiser: the gram in it with the least hash, the leftmost of
equal ones. Equal windows have equal owners, and neighbouring windows mostly
share one. Grams found in one document only are dropped first. Around each other
gram the bytes of its windows (a context) go to the bucket of the gram's hash.
There the suffixes of the different contexts are sorted with the lengths of their
common prefixes; a stack scan gives the intervals of the prefix tree, and the
intervals whose occurrences differ in the byte before are the maximal repeats,
with all their occurrences. An interval that doesn't is a part of a longer one.

Skew: exact copies of a whole text are settled by its digest. What a bucket
gets for a gram or a context is its smallest and largest document per batch of
documents, whatever the number of its occurrences; answers join back to the
batches by bucket. A gram in very many documents is split: its contexts become
single windows, each in the bucket of its own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, texts

LEAST, GRAM = 50, 20
#: Longest context: a gram with all windows that can own it.
LONGEST = 2 * LEAST - GRAM
#: Text bytes for each bucket, about.
BUCKET_BYTES = 1 << 19
#: Bits of a bucket that rows are dealt out by at once; with more of them a second dealing out follows, in parts of about so many bytes.
LEVEL, PART_BYTES, RECUT_BYTES = 12, 256 << 20, 16 << 20
#: Batches with a gram from which its windows are dealt out one by one.
HOT = 64
#: Parts of the copies of one text.
SALTS = 32
#: Windows of a text that are scanned at once; suffixes of a bucket that are sorted at once.
BLOCK, SORTED = 1 << 20, 200_000
#: Occurrences, and bytes of arrays, that a task holds before it passes them on.
HELD, HELD_BYTES = 100_000, 8 << 20
_MASK = np.uint64((1 << 24) - 1)


# --- packed columns -------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed value; bytes of equal weight side by side."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c)
        parts.append(np.int64(len(c)).tobytes() + c.dtype.str[1:].encode().ljust(2) + c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 10].decode().strip())
        at += 10
        shaped = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(shaped.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, x.dtype))


def by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array by its top bits."""
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(hashes)]):
            yield int(bucket[a]), slice(a, b)


def rows_of(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


BLOBS = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
DOCS = pa.schema([("doc_id", pa.int64()), ("blob", pa.binary())])
BLOBS_SQL, DOCS_SQL = "bucket long, blob binary", "doc_id long, blob binary"


def recut(rows: DataFrame, bits: int, total: int, cut) -> DataFrame:
    """Rows dealt out by the first LEVEL bits, dealt out by ``bits``: what many batches have for one of the coarse buckets is put together and cut anew.

    With buckets in proportion to the corpus, each batch would have a few bytes for
    each; so it has larger pieces for a fixed number of them first. A coarse bucket
    is split by a hash, so that no task holds one. cut(bits, rows) yields rows; it
    gets a list of tuples without the bucket.
    """
    if bits <= LEVEL:
        return rows
    parts = max(1, -(-total // (PART_BYTES << LEVEL)))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for bucket, *values in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                if held and (bucket != now or size > RECUT_BYTES):
                    yield from cut(bits, held)
                    held, size = [], 0
                now = bucket
                held.append(values)
                size += sum(map(len, values))
        if held:
            yield from cut(bits, held)

    part = F.pmod(F.xxhash64("blob"), F.lit(parts))
    return rows.repartition("bucket", part).sortWithinPartitions("bucket").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes))


# --- minimisers -------------------------------------------------------------------


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first and last window start of every owner, in text order."""
    parts = []
    for begin in range(0, len(text) - LEAST + 1, BLOCK):
        piece = text[begin : begin + BLOCK + LEAST - 1]
        n = len(piece) - GRAM + 1
        eight = np.ndarray((len(piece) - 7,), "<u8", piece, strides=(1,)).astype(np.uint64)
        gram = eight[:n]
        for at in (*range(8, GRAM - 8, 8), GRAM - 8):
            gram = mix64(gram) + eight[at : at + n]
        gram = mix64(gram)
        least = (gram & ~_MASK) | np.arange(n, dtype=np.uint64)
        width = 1
        while width < LEAST - GRAM + 1:  # the least of so many neighbours
            step = min(width, LEAST - GRAM + 1 - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        owner = (least & _MASK).astype(np.int64)
        cut = np.flatnonzero(np.diff(owner)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(owner)]]) - 1
        parts.append((gram[owner[first]], first + begin, last + begin))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def cut_prints(bits: int, held: list) -> Iterator[pa.RecordBatch]:
    parts = [unpack(blob) for (blob,) in held]
    h, d = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    yield from rows_of([(b, pack(deltas(h[s]), d[s])) for b, s in by_bucket(h, bits)], BLOBS)


def fingerprints(docs: DataFrame, bits: int, total: int) -> DataFrame:
    """(bucket, blob of gram hash and doc_id) for each batch of (doc_id, text)."""
    first = min(bits, LEVEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                h = np.unique(anchors(text)[0])
                hashes.append(h)
                owners.append(np.full(len(h), doc_id, np.int64))
            if hashes:
                h, d = np.concatenate(hashes), np.concatenate(owners)
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                yield from rows_of([(b, pack(deltas(h[s]), d[s])) for b, s in by_bucket(h, first)], BLOBS)

    return recut(docs.select("doc_id", "text").mapInArrow(run, BLOBS_SQL), bits, total, cut_prints)


def few(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per hash: its smallest and largest document, and the sum of counts."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    if not len(h):
        return hashes, low, high, count
    return h[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(count[order], first)


def shared_grams(prints: DataFrame) -> DataFrame:
    """(bucket, blob of gram hashes in two or more documents, and whether they are hot)."""

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d, docs = unpack(blob)
                h, low, high, n = few(np.cumsum(d), docs, docs, np.ones(len(docs), np.int64))
                rows.append((bucket, pack(deltas(h), low, high)))
            yield from rows_of(rows, BLOBS)

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in table.column("blob").to_pylist()]
        h, low, high = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        h, low, high, n = few(h, low, high, np.ones(len(h), np.int64))
        some = low < high
        blob = pack(deltas(h[some]), (n[some] >= HOT).astype(np.uint8))
        return pa.table({"bucket": table.column("bucket")[:1], "blob": pa.array([blob], pa.binary())}, schema=BLOBS)

    return prints.mapInArrow(condense, BLOBS_SQL).groupBy("bucket").applyInArrow(merge, BLOBS_SQL)


def cut_answers(bits: int, held: list) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*(unpack(blob) for (blob,) in held))]
    h = mix64(columns[0].view(np.uint64))
    order = np.lexsort((columns[0], h >> np.uint64(64 - bits)))
    h, columns = h[order], [c[order] for c in columns]
    yield from rows_of([(b, pack(*(c[s] for c in columns))) for b, s in by_bucket(h, bits)], BLOBS)


def answers_by_document(asked: DataFrame, keep, bits: int, total: int) -> DataFrame:
    """(doc_id, blob) from rows (bucket, blob, answer).

    keep(blob, answer) gives arrays, doc_ids first; they travel packed by a hash
    of doc_id and come out as one row per document.
    """
    first = min(bits, LEVEL)

    def flush(got: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*got)]
        h = mix64(columns[0].view(np.uint64))
        order = np.lexsort((columns[0], h >> np.uint64(64 - first)))
        h, columns = h[order], [c[order] for c in columns]
        yield from rows_of([(b, pack(*(c[s] for c in columns))) for b, s in by_bucket(h, first)], BLOBS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            for blob, answer in zip(batch.column(1), batch.column(2)):
                got.append(keep(blob.as_py(), answer.as_py()))
                size += sum(c.nbytes for c in got[-1])
                if size > HELD_BYTES:
                    yield from flush(got)
                    got, size = [], 0
        if got:
            yield from flush(got)

    def merge(table: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*(unpack(b) for b in table.column("blob").to_pylist()))]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        cut = np.flatnonzero(np.diff(columns[0])) + 1
        spans = list(zip([0, *cut.tolist()], [*cut.tolist(), len(order)]))
        ids = columns[0][[a for a, _ in spans]]
        return pa.table({"doc_id": ids, "blob": pa.array([pack(*(c[a:b] for c in columns[1:])) for a, b in spans], pa.binary())}, schema=DOCS)

    packed = recut(asked.select("bucket", "blob", "answer").mapInArrow(run, BLOBS_SQL), bits, total, cut_answers)
    return packed.groupBy("bucket").applyInArrow(merge, DOCS_SQL)


def wanted_grams(blob: bytes, answer: bytes) -> tuple[np.ndarray, ...]:
    d, docs = unpack(blob)
    h = np.cumsum(d)
    shared, hot = unpack(answer)
    shared = np.cumsum(shared)
    if not len(shared):
        return docs[:0], h[:0], hot[:0]
    at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
    some = shared[at] == h
    return docs[some], h[some], hot[at[some]]


# --- contexts ---------------------------------------------------------------------


def mark_of(text: bytes) -> int:
    """Tells the texts of one doc_id apart; 0 stands for an id with one text."""
    return xxhash.xxh3_64_intdigest(text) | 1


CONTEXTS = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("places", pa.binary())])


def cut_contexts(bits: int, held: list) -> Iterator[pa.RecordBatch]:
    """Contexts and places with the grams of contexts as the last array, which goes."""
    about = [np.concatenate(c) for c in zip(*(unpack(blob) for blob, _ in held))]
    key, size, low, high, raw, gram = about
    _, count, owner, where, mark = (np.concatenate(c) for c in zip(*(unpack(places) for _, places in held)))
    order = np.argsort(gram, kind="stable")

    def moved(values: list[np.ndarray], lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Runs of values of the given lengths in the order of grams, and where each begins."""
        begin, n = np.cumsum(lengths) - lengths, lengths[order]
        edge = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin[order] - edge[:-1], n) + np.arange(edge[-1])
        return [v[at] for v in values], edge

    (raw,), of_raw = moved([raw], size.astype(np.int64))
    (owner, where, mark), of_place = moved([owner, where, mark], count.astype(np.int64))
    key, size, low, high, gram, count = (c[order] for c in (key, size, low, high, gram, count))
    rows = []
    for b, s in by_bucket(gram, bits):
        r, p = slice(of_raw[s.start], of_raw[s.stop]), slice(of_place[s.start], of_place[s.stop])
        rows.append((b, pack(key[s], size[s], low[s], high[s], raw[r]), pack(key[s], count[s], owner[p], where[p], mark[p])))
    yield from rows_of(rows, CONTEXTS)


def contexts(docs: DataFrame, bits: int, total: int) -> DataFrame:
    """(bucket, blob, blob of occurrences) for each HELD occurrences in (doc_id, text, blob of shared grams, whether the id repeats).

    blob: id, length, smallest and largest document of the batch's different
    contexts, and their bytes. Places: per context its id, then how many,
    their documents, where they start and the marks of their texts.
    """
    coarse = min(bits, LEVEL)

    def flush(known: dict[bytes, int], grams: list[int], which: list[int], owner: list[int], where: list[int], mark: list[int]) -> Iterator[pa.RecordBatch]:
        pieces = list(known)
        gram, which = np.array(grams, np.uint64), np.array(which, np.int64)
        owner, where, mark = np.array(owner, np.int64), np.array(where, np.int64), np.array(mark, np.uint64)
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
        order = np.argsort(gram, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = place[which]
        by = np.lexsort((owner, which))
        which, owner, where, mark = which[by], owner[by], where[by], mark[by]
        edge = np.searchsorted(which, np.arange(len(order) + 1))
        rows = []
        for bucket, s in by_bucket(gram[order], coarse):
            a, b = edge[s.start], edge[s.stop]
            own = [pieces[k] for k in order[s].tolist()]
            start, end = edge[s.start : s.stop], edge[s.start + 1 : s.stop + 1]
            key = ids[order[s]]
            more = [gram[order[s]]] if coarse < bits else []
            blob = pack(key, np.fromiter(map(len, own), np.uint8, len(own)), owner[start], owner[end - 1], np.frombuffer(b"".join(own), np.uint8), *more)
            rows.append((bucket, blob, pack(key, (end - start).astype(np.int32), owner[a:b], where[a:b], mark[a:b])))
        yield from rows_of(rows, CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lists = {}, ([], [], [], [], [])
        grams, which, owner, where, mark = lists
        for batch in batches:
            for doc_id, text, blob, repeats in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2), batch.column(3).to_pylist()):
                own = mark_of(text) if repeats else 0
                shared, hot = unpack(blob.as_py())
                order = np.argsort(shared)
                shared, hot = shared[order], hot[order]
                h, first, last = anchors(text)
                at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
                some = shared[at] == h
                h, first, last, hot = h[some], first[some], last[some], hot[at[some]]
                for g, a, b, split in zip(h.tolist(), first.tolist(), last.tolist(), hot.tolist()):
                    for x, y in [(a, b)] if not split else [(k, k) for k in range(a, b + 1)]:
                        piece = text[x : y + LEAST]
                        k = known.get(piece)
                        if k is None:
                            k = known[piece] = len(grams)
                            grams.append(xxhash.xxh3_64_intdigest(piece) if split else g)
                        which.append(k)
                        owner.append(doc_id)
                        where.append(x)
                        mark.append(own)
                if len(where) > HELD:
                    yield from flush(known, *lists)
                    for x in (known, *lists):
                        x.clear()
        if grams:
            yield from flush(known, *lists)

    return recut(docs.select("doc_id", "text", "blob", "repeats").mapInArrow(run, "bucket long, blob binary, places binary"), bits, total, cut_contexts)


# --- the prefix tree ----------------------------------------------------------------


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the prefix tree, by a stack scan.

    lcp[k] is the common prefix of the suffixes k and k + 1 in their order.
    """
    out, stack = [], [(0, 0)]
    for k, value in enumerate([*lcp, 0]):
        start = k
        while stack[-1][0] > value:
            length, start = stack.pop()
            if length >= least:
                out.append((length, start, k))
        if stack[-1][0] < value:
            stack.append((value, start))
    return out


def windows_at(data: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """A hash of the ``least`` bytes from each place on."""
    if least < 8:
        h = np.zeros(len(at), np.uint64)
        for k in range(least):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + data[at + k]
        return mix64(h)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = eight[at]
    for k in (*range(8, least - 8, 8), least - 8):
        h = mix64(h) + eight[at + k]
    return mix64(h)


def maximal_repeats(pieces: list[bytes], least: int = LEAST) -> Iterator[list[np.ndarray]]:
    """(group, length, piece, offset) of every occurrence of every maximal repeat, in parts; groups are numbered in each.

    Pieces are different byte strings of at most LONGEST bytes, without 0xFF. An
    occurrence at the start of a piece counts as differing in the byte before.
    Suffixes that begin with the same ``least`` bytes are sorted together, some
    SORTED of them at a time; one that shares its begin with no other has none.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"\xff".join([b"", *pieces, b"\xff" * LONGEST]), np.uint8)
    begins = np.cumsum(np.concatenate([[0], sizes + 1]))[:-1] + 1
    n = np.maximum(sizes - least + 1, 0)
    total = int(n.sum())
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), n)
    at = np.arange(total) + np.repeat(begins - (np.cumsum(n) - n), n)
    h = windows_at(data, at, least)
    order = np.argsort(h, kind="stable")
    h = h[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if total else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, total))
    several = np.repeat(size > 1, size)
    order, size = order[several], size[size > 1]
    ends = np.cumsum(size)
    done = 0
    while done < len(order):
        k = max(np.searchsorted(ends, done + SORTED, "right") - 1, np.searchsorted(ends, done, "right"))
        some = order[done : ends[k]]
        done = int(ends[k])
        yield from _sorted_repeats(data, sizes, begins, piece[some].astype(np.int64), at[some], least)


def _sorted_repeats(data: np.ndarray, sizes: np.ndarray, begins: np.ndarray, piece: np.ndarray, at: np.ndarray, least: int) -> Iterator[list[np.ndarray]]:
    """maximal_repeats() among some suffixes; a part has about SORTED occurrences, or one group."""
    offset = at - begins[piece]
    keys = np.lib.stride_tricks.sliding_window_view(data, LONGEST)[at]
    order = np.argsort(keys.view(f"S{LONGEST}").ravel(), kind="stable")
    keys, piece, offset, at = keys[order], piece[order], offset[order], at[order]
    rest = sizes[piece] - offset
    differ = keys[1:] != keys[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), LONGEST)
    lcp = np.minimum(lcp, np.minimum(rest[1:], rest[:-1]))
    left = data[at - 1]
    # runs of suffixes with a common prefix that is long enough
    joined = np.concatenate([[False], lcp >= least, [False]])
    begin = np.flatnonzero(joined[1:] & ~joined[:-1])
    end = np.flatnonzero(joined[:-1] & ~joined[1:])
    if not len(begin):
        return
    bounds = np.column_stack([begin, end]).ravel()
    shallow, deep = (f.reduceat(np.append(lcp, 0), bounds)[::2] for f in (np.minimum, np.maximum))
    even = shallow == deep
    low, high, length = [begin[even]], [end[even]], [shallow[even]]
    nested = [(size, a + x, a + y) for a, b in zip(begin[~even].tolist(), end[~even].tolist()) for size, x, y in intervals(lcp[a:b].tolist(), least)]
    if nested:
        size, x, y = np.array(nested, np.int64).T
        low.append(x), high.append(y), length.append(size)
    low, high, length = np.concatenate(low), np.concatenate(high), np.concatenate(length)
    # left-extension diversity: positions in [low, high) where the byte before changes, or is unknown
    change = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (left[1:] == 255) | (left[:-1] == 255))])
    diverse = change[high] > change[low]
    low, high, length = low[diverse], high[diverse], length[diverse]
    ends = np.cumsum(high - low + 1)
    done = 0
    while done < len(low):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SORTED, "right")))
        a, b, size = low[done:stop], high[done:stop], length[done:stop]
        done = stop
        n = b - a + 1
        group = np.repeat(np.arange(len(a)), n)
        member = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield [group, np.repeat(size, n), piece[member], offset[member]]


def covered(key: np.ndarray, offset: np.ndarray, length: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks by context, those of one context and document that overlap or touch as one: later documents lose the same bytes."""
    order = np.lexsort((offset, least, key))
    key, offset, least = key[order], offset[order].astype(np.int64), least[order]
    end = offset + length[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (least[1:] != least[:-1])]) if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) << 8  # ends are below 256
    reached = np.maximum.accumulate(end + group) - group
    new[1:] |= offset[1:] > reached[:-1]
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(end, first) if len(first) else end
    return key[first], offset[first].astype(np.uint8), (end - offset[first]).astype(np.uint8), least[first]


def marks(found: DataFrame) -> DataFrame:
    """(bucket, answer): what is to be removed from each context.

    answer: context id, offset, length and the smallest document with the
    repeat; occurrences in later documents lose those bytes.
    """

    def solve(table: pa.Table) -> pa.Table:
        pieces: dict[bytes, int] = {}
        ids, low, high = [], [], []
        for blob in table.column("blob").to_pylist():
            key, size, a, b, raw = unpack(blob)
            raw, at = raw.tobytes(), 0
            for i, n, x, y in zip(key.tolist(), size.tolist(), a.tolist(), b.tolist()):
                piece = raw[at : at + n]
                at += n
                k = pieces.setdefault(piece, len(ids))
                if k == len(ids):
                    ids.append(i), low.append(x), high.append(y)
                else:
                    low[k], high[k] = min(low[k], x), max(high[k], y)
        ids, low, high = np.array(ids, np.uint64), np.array(low, np.int64), np.array(high, np.int64)
        # a context in several documents is a repeat itself
        alone = np.flatnonzero(low < high)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = [(ids[alone], np.zeros(len(alone), np.uint8), sizes[alone].astype(np.uint8), low[alone])]
        for group, length, piece, offset in maximal_repeats(list(pieces)):
            first = np.flatnonzero(np.diff(group, prepend=-1))
            least = np.minimum.reduceat(low[piece], first)[group]
            some = (high[piece] > least) & ~((offset == 0) & (length == sizes[piece]) & (least == low[piece]))
            out.append((ids[piece[some]], offset[some].astype(np.uint8), length[some].astype(np.uint8), least[some]))
        blob = pack(*covered(*map(np.concatenate, zip(*out))))
        return pa.table({"bucket": table.column("bucket")[:1], "answer": pa.array([blob], pa.binary())}, schema=pa.schema([("bucket", pa.int64()), ("answer", pa.binary())]))

    return found.select("bucket", "blob").groupBy("bucket").applyInArrow(solve, "bucket long, answer binary")


def removals(places: bytes, answer: bytes) -> tuple[np.ndarray, ...]:
    """doc_id, start, length of the bytes to remove, and the mark of the text."""
    key, count, owner, where, text = unpack(places)
    about, offset, length, least = unpack(answer)
    begin = np.cumsum(count) - count
    low, high = np.searchsorted(about, key, "left"), np.searchsorted(about, key, "right")
    n = (high - low).astype(np.int64)
    context = np.repeat(np.arange(len(key)), n)
    mark = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    m = count[context].astype(np.int64)
    which = np.repeat(np.arange(len(context)), m)
    place = np.repeat(begin[context], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    some = owner[place] > least[mark[which]]
    which, place = which[some], place[some]
    return owner[place], where[place] + offset[mark[which]].astype(np.int64), length[mark[which]].astype(np.int64), text[place]


def merged(start: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs inside a text of that size."""
    if not len(start):
        return start, start
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    start, end = start[first], np.minimum(end[np.append(first[1:], len(end)) - 1], size)
    some = start < end
    return start[some], end[some]


# --- the operator -------------------------------------------------------------------


def spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, copies, blob): for documents that lose bytes.

    copies: digests of texts that an earlier document has as a whole; blob:
    starts and lengths of removed bytes, and the marks of the texts they are in.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LEAST)).withColumn("digest", F.md5(F.col("text").cast("binary")))
    ids = scratch.save(docs.select("doc_id", "digest"), "digests")
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last").drop("_last")
    # a text with very many copies is dealt out by salts
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ids.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = scratch.save(salted.join(first, ["digest", "_salt"]).filter("doc_id > _first").select("doc_id", "digest").distinct(), "copies")
    repeats = ids.groupBy("doc_id").agg(F.min("digest").alias("_x"), F.max("digest").alias("_y")).filter("_x != _y").select("doc_id", F.lit(True).alias("repeats"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    bits = max(4, min(40, int(total // BUCKET_BYTES).bit_length()))
    # a merge join at any size: the plan for small tables would be another one
    single = docs.join(copies.hint("merge"), ["doc_id", "digest"], "left_anti")
    prints = scratch.save(fingerprints(single, bits, total), "prints")
    shared = scratch.save(shared_grams(prints), "shared")
    asked = prints.join(shared.withColumnRenamed("blob", "answer"), "bucket")
    wanted = scratch.save(answers_by_document(asked, wanted_grams, bits, total), "wanted")
    scratch.drop("prints", "shared")
    wanted = wanted.join(repeats, "doc_id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(False)))
    found = scratch.save(contexts(docs.drop("digest").join(wanted, "doc_id"), bits, total), "contexts")
    scratch.drop("wanted")
    asked = found.select("bucket", F.col("places").alias("blob")).join(scratch.save(marks(found), "marks"), "bucket")
    lost = scratch.save(answers_by_document(asked, removals, bits, total), "lost")
    scratch.drop("contexts", "marks")
    whole = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("copies"))
    return lost.join(whole, "doc_id", "full")


def cut_texts(docs: DataFrame, lost: DataFrame, texts_too: bool = False) -> DataFrame:
    """Applies spans(): n_bytes, n_removed, n_spans, kept_sha256, and the kept text if asked for."""
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    rest = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name not in ("doc_id", "text")] if texts_too else []
    held = F.struct(*[F.col(n) for n, _ in rest]) if rest else F.lit(None).cast("struct<x:int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for doc_id, text, blob, copies in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                start = end = np.empty(0, np.int64)
                if len(text) >= LEAST and copies and hashlib.md5(text).hexdigest() in copies:
                    start, end = np.array([0]), np.array([len(text)])
                elif blob is not None:
                    start, length, mark = unpack(blob)
                    if mark.any():
                        own = mark == mark_of(text)
                        start, length = start[own], length[own]
                    start, end = merged(start, length, len(text))
                left = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)])) if len(start) else text
                rows.append((doc_id, len(text), int((end - start).sum()), len(start), hashlib.sha256(left).hexdigest()))
                kept.append(left.decode(errors="ignore"))
            if rows:
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), names)]
                if texts_too:
                    columns += [pa.array(kept, pa.string()), batch.column(4)]
                yield pa.RecordBatch.from_arrays(columns, [n for n, _ in names] + (["text", "held"] if texts_too else []))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    joined = plain.join(lost, "doc_id", "left").select("doc_id", "text", "blob", "copies", "held")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts_too:
        schema += ", text string, held " + joined.schema["held"].dataType.simpleString()
    return joined.mapInArrow(run, schema)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs.

    Removed is each byte covered by a LEAST-byte string that also starts in a
    document with a smaller doc_id. Null text is empty; shorter texts lose
    nothing; rows with the same doc_id are one document: they don't take bytes
    from each other, and each text of it loses its own; a null doc_id takes no
    part and loses nothing; an empty table gives no row; other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    return cut_texts(docs.select("doc_id", "text"), spans(docs, scratch))
