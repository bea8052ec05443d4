"""Language-model scoring: word counts, and a hidden Markov model over word classes.

Counts of all training words come first; they give the base score. For the
hidden Markov model the most frequent words and the end are classes of their
own, every other word falls into a class by its last letters. A state emits a
class, and the class a word by its smoothed count, so the model gives every text
a probability. Baum-Welch runs over all training texts: each task sums expected
counts, the sums meet in a shuffle, and only they (states by classes) reach the
driver. Texts of about one length run side by side, whole. Very long ones run in
stretches: products of the model's matrices give what every stretch is told by
the text before and behind it, so the counts are those of the whole text. The scaled forward recursion over whole texts gives the likelihood.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, texts

#: Hidden states, rounds of Baum-Welch.
STATES, ROUNDS = 8, 5
#: Words with a class of their own, and classes of the others.
OWN, TAIL = 4000, 256
#: Words whose counts every task holds; the counts of the others are joined.
HELD = 60_000
#: Longest text that is run through whole in training, and the stretches of longer ones.
WHOLE, STRETCH = 16_384, 512
#: Tokens in a pass, tokens that are held to be sorted by the lengths of their texts, and steps between scalings.
PASS, SORTED, SCALED = 200_000, 2_000_000, 8
END_CLASS, CLASSES = OWN + TAIL, OWN + TAIL + 1


def trains(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def tail_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % TAIL


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the training texts; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if trains(doc_id):
                    counts.update(text.translate(LOWER).split())
                    counts[b""] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int | None = None) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, HELD at most: all above a count that a histogram by powers shows."""
    most = HELD if most is None else most
    level = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level)  # 1024 rows at most
    least, total = None, 0
    for r in histogram:
        total += r.words
        if total > most:
            break
        least = r.level
    return [] if least is None else [(bytes(r.word), r.n) for r in words.filter(level >= least).collect()]


def encode(docs: DataFrame, held: dict[bytes, tuple[int, int]]) -> DataFrame:
    """Each text as class ids, with the sum over held words; the other words stay to be joined."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("classes", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
    logs = {w: float(np.log10(c + 0.5)) for w, (c, _) in held.items()}
    end = logs.get(b"", float(np.log10(0.5)))
    ends = int(b"" in held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40

        class Classes(dict):
            def __missing__(self, word: bytes) -> int:
                return held[word][1] if word in held else tail_class(word)

        classes = Classes({w: k for w, (_, k) in held.items()})
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                words = text.translate(LOWER).split()
                ids = np.fromiter(map(classes.__getitem__, words), "<u2", len(words))
                counts = Counter(words)
                rest = [w for w in counts if w not in logs]
                others = [counts.pop(w) for w in rest]
                total = sum(logs[w] * n for w, n in counts.items()) + end
                rows.append((row, doc_id, not trains(doc_id), len(words) + 1, sum(counts.values()) + ends, total, np.append(ids, END_CLASS).astype("<u2").tobytes(), rest, others))
                row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    sql = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, classes binary, words array<binary>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, sql)


def stretches(blobs: Iterable[bytes], model: tuple[np.ndarray, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Texts and stretches of long ones, longest first, in passes of about PASS tokens, with what is before and behind each.

    before: the distribution of the state before the stretch (NaN where a text
    begins); behind: how likely the rest of the text is from each state, up to
    a factor.
    """
    states = len(model[1])
    alone = np.full(states, np.nan), np.ones(states)
    held, size = [], 0

    def passes() -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        held.sort(key=lambda x: -len(x[0]))
        ends = np.cumsum([len(x[0]) for x in held])
        begin = 0
        while begin < len(held):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PASS, "right")))
            yield [x[0] for x in held[begin:end]], np.array([x[1] for x in held[begin:end]]), np.array([x[2] for x in held[begin:end]])
            begin = end
        held.clear()

    for blob in blobs:
        ids = np.frombuffer(blob, "<u2")
        if len(ids) <= WHOLE:
            held.append((ids, *alone))
        else:
            held += [(ids[k * STRETCH : (k + 1) * STRETCH], *around) for k, around in enumerate(borders(ids, model))]
        size += len(ids)
        if size >= SORTED:
            yield from passes()
            size = 0
    yield from passes()


def borders(ids: np.ndarray, model: tuple[np.ndarray, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(before, behind) of every stretch of a long text.

    The matrix of a stretch is emission, step, emission, ..., emission: from the
    state of its first token to that of its last. All are made side by side, one
    row for each first state; 64 numbers stand for STRETCH tokens.
    """
    start, move, emit = model
    states, n = len(move), -(-len(ids) // STRETCH)
    products = np.zeros((n, states, states))
    for at in range(0, n, max(1, PASS // (STRETCH * states))):
        part = [ids[k * STRETCH : (k + 1) * STRETCH] for k in range(at, min(n, at + max(1, PASS // (STRETCH * states))))]
        now = np.tile(np.eye(states), (len(part), 1, 1))
        for t, c in enumerate(columns(part)):  # all but the last are equally long
            live = len(c)
            now[:live] = (now[:live] if t == 0 else now[:live] @ move) * emit[c][:, None, :]
            now[:live] /= now[:live].max(axis=(1, 2), keepdims=True)
        products[at : at + len(part)] = now
    before, behind = [np.full(states, np.nan)], [np.ones(states)]
    at = start[0]
    for k in range(n - 1):
        after = at @ products[k]
        before.append(after / after.sum())
        at = before[-1] @ move
    for k in range(n - 1, 0, -1):
        rest = move @ (products[k] @ behind[-1])
        behind.append(rest / rest.max())
    return list(zip(before, reversed(behind)))


def columns(pieces: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The t-th ids of the sequences that reach t; sequences are longest first."""
    sizes = np.array([len(p) for p in pieces])
    flat, start = np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    alive = len(pieces)
    for t in range(int(sizes[0])):
        while sizes[alive - 1] <= t:
            alive -= 1
        yield flat[start[:alive] + t]


def expected(pieces: list[np.ndarray], before: np.ndarray, behind: np.ndarray, model: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Expected counts of starts, transitions and emissions, of whole texts or of their stretches().

    Tokens lie step by step: the t-th ones of all texts that reach t, longest text
    first. Both recursions are scaled every few steps by any factor, as each
    token's posterior is made to sum to one in the end.
    """
    start, move, emit = model
    sizes = np.array([len(p) for p in pieces])
    steps = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")
    at = np.concatenate([[0], np.cumsum(alive)])
    place = at[np.arange(at[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)] + np.repeat(np.arange(len(sizes)), sizes)
    flat = np.empty(at[-1], np.int64)
    flat[place] = np.concatenate(pieces)
    weight = emit[flat]
    forward = np.empty_like(weight)
    begins = np.isnan(before[:, 0])
    enter = np.where(begins[:, None], start[0], np.nan_to_num(before) @ move)
    forward[: at[1]] = enter * weight[: at[1]]
    for t in range(1, steps):
        now = forward[at[t] : at[t + 1]]
        np.matmul(forward[at[t - 1] : at[t - 1] + alive[t]], move, out=now)
        now *= weight[at[t] : at[t + 1]]
        if t % SCALED == 0:
            now /= now.sum(axis=1, keepdims=True)
    backward, back = np.empty_like(weight), np.ascontiguousarray(move.T)
    backward[at[sizes - 1] + np.arange(len(sizes))] = behind
    for t in range(steps - 1, -1, -1):
        now = weight[at[t] : at[t + 1]]
        now *= backward[at[t] : at[t + 1]]
        if t % SCALED == 0:
            now /= now.max(axis=1, keepdims=True)
        if t:
            np.matmul(now, back, out=backward[at[t - 1] : at[t - 1] + alive[t]])
    backward *= forward
    total = backward.sum(axis=1)
    backward /= total[:, None]
    previous = np.arange(at[1], at[-1]) - np.repeat(alive[:-1], alive[1:])
    moves = forward[previous].T @ (weight[at[1] :] / total[previous][:, None])
    inside = ~begins
    if inside.any():  # the step into a stretch belongs to it
        first = weight[: at[1]][inside]
        moves += before[inside].T @ (first / (enter[inside] * first).sum(axis=1, keepdims=True))
    emits = np.stack([np.bincount(flat, backward[:, k], CLASSES) for k in range(len(move))])
    return backward[: at[1]][begins].sum(axis=0), moves * move, emits


def train(encoded: DataFrame, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Starts, transitions and emissions (by class, then state) from all training texts.

    counts: the training tokens of each class.
    """
    shape = [states, states * states, states * CLASSES]
    random = np.random.Generator(np.random.PCG64(9))
    usual = (counts + 0.5) / (counts + 0.5).sum()
    emit = (usual * random.gamma(1.0, 1.0, (states, CLASSES)).clip(0.05)).T
    model = (np.full((1, states), 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))
    learn = encoded.filter("NOT held_out").select("classes")

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(shape))
            blobs = (value.as_py() for batch in batches for value in batch.column(0))
            for pieces, before, behind in stretches(blobs, model):
                first, moves, emits = expected(pieces, before, behind, model)
                total += np.concatenate([first, moves.ravel(), emits.ravel()])
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "x"])

        got = learn.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()  # at most as many rows as the model has numbers
        total = np.zeros(sum(shape))
        total[got.column(0).to_numpy()] = got.column(1).to_numpy()
        first, moves, emits = np.split(total, np.cumsum(shape)[:-1])
        first, moves, emits = first.reshape(1, states) + 1, moves.reshape(states, states) + 1, emits.reshape(states, CLASSES) + 10 * usual
        model = (first / first.sum(axis=1, keepdims=True), moves / moves.sum(axis=1, keepdims=True), (emits / emits.sum(axis=1, keepdims=True)).T)
    return model


def likelihoods(blobs: list[bytes], model: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 probability of each whole class sequence."""
    start, move, emit = model
    order = sorted(range(len(blobs)), key=lambda k: -len(blobs[k]))
    out = np.zeros(len(blobs))
    now = np.repeat(start[:1], len(blobs), axis=0)
    for t, c in enumerate(columns([np.frombuffer(blobs[k], "<u2") for k in order])):
        now = (now if t == 0 else now[: len(c)] @ move) * emit[c]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        out[: len(c)] += np.log10(scale)
    back = np.empty(len(blobs))
    back[order] = out
    return back


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from the rows whose crc32(doc_id as text) mod 5 is not 1 (a null id
    counts as the empty text). Null and empty texts are just an end. Repeated
    rows are scored each, and counted each. Without training rows every score is
    that of an untrained model. An empty table gives no row; other columns are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    words = scratch.save(count_words(docs), "words")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    trained, distinct = int(whole[0]), int(whole[1])
    top = sorted(frequent(words.filter("length(word) > 0")), key=lambda r: (-r[1], r[0]))
    held = {word: (n, k if k < OWN else tail_class(word)) for k, (word, n) in enumerate(top)}
    ends = words.filter("length(word) = 0").first()
    if ends:
        held[b""] = (ends.n, END_CLASS)
    counts, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for n, k in held.values():
        counts[k] += n
        kinds[k] += 1
    known = docs.sparkSession.createDataFrame([(w,) for w in held], "word binary")
    rest = words.join(known, "word", "left_anti")
    tail = rest.groupBy(F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(TAIL)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # TAIL rows
    for r in tail:
        counts[OWN + r.k] += r.n
        kinds[OWN + r.k] += r.v
    encoded = scratch.save(encode(docs, held), "encoded")
    model = train(encoded, counts, states, rounds)
    mass = np.where(np.arange(CLASSES) // OWN == 1, counts + 0.5 * (kinds + 1), counts + 0.5)
    mass[END_CLASS] = counts[END_CLASS] + 0.5
    log_mass = np.log10(mass)
    log_all = float(np.log10(trained + 0.5 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blobs = batch.column("classes").to_pylist()
                within = [float(log_mass[np.frombuffer(b, "<u2")].sum()) for b in blobs]
                plain = batch.drop_columns(["classes"])
                yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(likelihoods(blobs, model) - np.array(within))], [*plain.schema.names, "likelihood"])

    kept = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double"
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "classes").mapInArrow(run, kept + ", likelihood double")
    others = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("_w")).select("row", F.col("_w.words").alias("word"), F.col("_w.times").alias("times"))
    found = others.join(rest, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_known")
    )
    out = scored.join(found, "row", "left").withColumn("_sum", F.col("logs") + F.coalesce("_logs", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(trained).cast("long").alias("train_tokens"),
        (F.col("_sum") - F.col("n_tokens") * log_all).alias("base_score"), (F.col("_sum") + F.col("likelihood")).alias("score"),
    )
