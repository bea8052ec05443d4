"""The ten operators and the pipeline against plain versions, on awkward rows."""

import io
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from radlake.llm import ann, extract, licenses, lm, minhash, mixing, packing, quality, suffix, tokens

from . import brute


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# 1, 5 ---------------------------------------------------------------------------------


def test_packing(docs, rows):
    got = packing.pack_documents(docs).collect()
    whole = {i: brute.ids(t) for i, t, _ in rows}
    covered = {}
    for r in got:
        piece = whole[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length <= 2048 and brute.crc(piece) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    twice = rows[-1][0]
    for i, spans in covered.items():
        ends = sorted(spans)[:: 2 if i == twice else 1]
        assert sum(n for _, n in ends) == len(whole[i]) and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert set(covered) == set(whole)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def test_packing_of_histograms():
    rng = random.Random(3)
    for _ in range(20):
        h = {rng.randint(1, 64): rng.randint(1, 5000) for _ in range(rng.randint(1, 40))}
        packs = packing.pack(h, 64)
        back = {}
        for content, n in packs:
            assert sum(s * t for s, t in content) <= 64
            for s, t in content:
                back[s] = back.get(s, 0) + t * n
        assert back == h and len(packs) <= 128
        places = packing.slots(packs)
        for size, n in h.items():
            mine = sorted((a, b) for s, a, b, *_ in places if s == size)
            assert mine[0][0] == 0 and mine[-1][1] == n and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))


def test_token_files(docs, rows):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_files(docs).collect())
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        x = brute.ids(t)
        want.append((start, i, len(x), brute.crc(x)))
        start += len(x)
    assert got == want


def test_token_file_format():
    rng = np.random.default_rng(0)
    docs = [(None, b"")] + [(k * 3, rng.integers(0, 50000, rng.integers(0, 300)).astype("<u4").tobytes()) for k in range(200)]
    out = io.BytesIO()
    tokens.write_file(out, docs, 4096)
    file = pa.BufferReader(out.getvalue())
    assert list(tokens.read_file(file)) == docs
    table = tokens.seek_table(file)
    assert len(table) > 10 and [x for x in tokens.read_file(file, {9, 300, 301})] == [docs[4], docs[101]]
    damaged = bytearray(out.getvalue())
    damaged[table[3][0] + table[3][1] - 2] ^= 1
    with pytest.raises(Exception):
        list(tokens.read_file(pa.BufferReader(bytes(damaged))))


# 2 --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees(spark):
    return extract.train(spark)


def test_extraction_on_pages_held_out(trees):
    rng = np.random.Generator(np.random.PCG64(99))
    right = total = 0
    for _ in range(120):
        page, labels = extract.made_page(rng)
        nodes, _ = extract.parse(page)
        kept = extract.decode(nodes, extract.log_odds(trees, nodes))
        right += (kept == np.array(labels)).sum()
        total += len(labels)
        assert all(n.parent is None or kept[n.parent.index] for n in nodes if kept[n.index])
    assert right / total > 0.98


def test_extraction_of_pages(spark, trees):
    page = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><nav><ul><li><a href=/x>Home</a></ul></nav><div class="ad">buy</div>
    <article><h1>Head  &amp; line</h1><p><b>First   paragraph with some text in it<br><p>Second &eacute; &#233;&nbsp;one, that is
    longer than the first paragraph<!-- no --> was.</p></article><div id="comments"><p>I disagree with it</p></div><footer>&copy; me</footer></body></html>"""
    rows = [(1, "u", page, 7), (2, None, None, 7), (3, "v", "", 7), (4, "w", page[:430], 7), (4, "w", page[:430], 7), (5, "x", "<p", 7), (6, "y", "plain text only", 7)]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), trees).collect()}
    assert got[1].text == "Head & line\nFirst paragraph with some text in it\nSecond é é one, that is longer than the first paragraph was."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[5].text == "" and got[4].text.startswith("Head & line\nFirst paragraph")
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), trees).count() == 0


# 3 --------------------------------------------------------------------------------------


def test_license_base(docs, rows):
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for i, t, _ in rows:
        w = word.findall((t or "").translate(brute.LOWER))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = licenses.scan(docs)
    assert collected(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_join_is_exact():
    rng = random.Random(4)
    pool = sorted(frozenset().union(*(t for _, t in licenses.templates()))) + [b"zz", b"yy"]
    matcher = licenses.Matcher({w: rng.randint(0, 50) for w in pool})
    for _ in range(600):
        label, own = rng.choice(licenses.templates())
        block = rng.sample(sorted(own), rng.randint(len(own) * 6 // 10, len(own))) + rng.sample(pool, rng.randint(0, 9))
        rng.shuffle(block)
        want = {(n, len(t & set(block)) / len(t)) for n, t in licenses.templates() if len(t & set(block)) >= math.ceil(licenses.THRESHOLD * len(t) - 1e-9)}
        assert set(matcher.match(block)) == want


# 4 --------------------------------------------------------------------------------------


def test_near_duplicates(docs, rows):
    want = brute.components(rows)
    got = minhash.near_duplicates(docs, minhash.QUERY_PERCENT).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_near_copies_of_one_document(spark):
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(300)]
    base = [rng.choice(pool) for _ in range(150)]
    rows = []
    for i in range(120):  # graded edits: some link to the first only, some to none
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(4000)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.QUERY_PERCENT).collect()
    want = brute.components(rows)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    assert len({c for _, c in want.values()}) > 5


def test_components(spark):
    from radlake.llm.common import Scratch

    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 101), (200, 201)]
    got = minhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c")
    comp = {r.node: r.component for r in got.collect()}
    assert all(comp[k] == 0 for k in range(61)) and comp[101] == comp[100] == comp[90] == 90 and comp[201] == 200


# 6 --------------------------------------------------------------------------------------


def test_quality(docs, rows):
    got = collected(quality.quality(docs), "doc_id", *quality.COUNTS, "base_failed")
    assert got == sorted(((i, *brute.quality(t)) for i, t, _ in rows), key=str)


def test_line_frequency(spark):
    menu = [(k, "home about contact\nnews today\n" + ("" if k % 2 else f"a text {k} that is not shared by any other page of this host and so it stays as it is, with all its words"), "h") for k in range(70)]
    copies = [(100 + k, "short lines\nonly short lines\nof one text\nthat was copied\nvery many times\nit has enough words\nto pass all the rest", "h") for k in range(80)]
    rows = [(i, "fill words so that the text is long enough for the base rules to pass it on here\n" * 0 + t if i >= 70 else t + " " + "more words of the menu of the site", s) for i, t, s in menu + copies]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k] for k in range(0, 70, 2)) and not any(got[k] for k in range(1, 70, 2)) and all(got[100 + k] for k in range(80))


# 7 --------------------------------------------------------------------------------------


def exact_neighbours(rows, every=50, nearest=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != ids[q]][:nearest]
        out[ids[q]] = [(int(ids[k]), s[k]) for k in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(700)] + [(1000 + k, [1.0] * 8) for k in range(40)] + [(2000, None), (2050, [0.0] * 8), (2051, [1.0, None] * 4), (2052, [math.inf] * 8), (2053, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v int, score int")
    want = exact_neighbours(rows)
    got = {}
    for r in sorted(ann.neighbours(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(want[q], got[q]))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.neighbours(few).collect()] == [(0, 1)]
    assert ann.neighbours(few.limit(0)).count() == 0


def test_neighbours_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(8 if k % 2 else 5).tolist()) for k in range(1200)]
    rows += [(50, rng.standard_normal(5).tolist()), (50, rows[77][1]), (77, rows[77][1]), (100, rows[3][1])]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    cosine = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    for q in range(0, 1200, 50):
        best = {}
        for mine in (np.array(v) for i, v in rows if i == q):
            for i, v in rows:
                if i != q and len(v) == len(mine):
                    best[i] = max(best.get(i, -2), cosine(mine, np.array(v)))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5]
        have = sorted(got[q])
        assert [i for _, i, _ in have] == [i for i, _ in want] and np.allclose([s for *_, s in have], [s for _, s in want])


def test_recall_of_the_windows_alone(spark):
    """What README says: on nearly isotropic vectors the windows find a part, which falls with the table; the whole search finds all."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    exact = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        exact[int(ids[q])] = set(ids[np.lexsort((ids, -s))[:5]].tolist())
    recall = {}
    for complete in (False, True):
        got = {}
        for r in ann.neighbours(vectors, complete=complete).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall[complete] = sum(len(got.get(q, set()) & v) for q, v in exact.items()) / sum(map(len, exact.values()))
    assert recall[True] == 1 and recall[False] >= 0.9


def test_hilbert_curve_is_a_walk():
    cells = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    key = ann.hilbert(cells, 2)
    walk = cells[np.argsort(key)]
    assert sorted(key) == list(range(64)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# 8 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [64, 1])
def test_substrings(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = collected(suffix.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((x[:5] for x in brute.substrings(rows)), key=str)


@pytest.mark.parametrize("part_bytes, recut_bytes", [(256 << 20, 16 << 20), (1, 300)])
def test_substrings_dealt_out_twice(docs, rows, part_bytes, recut_bytes, monkeypatch):
    """More buckets than are dealt out at once, in one part each and in many."""
    for name, value in (("LEVEL", 2), ("BUCKET_BYTES", 1 << 9), ("HOT", 3), ("PART_BYTES", part_bytes), ("RECUT_BYTES", recut_bytes), ("HELD", 50), ("BLOCK", 256)):
        monkeypatch.setattr(suffix, name, value)
    got = collected(suffix.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted((x[:5] for x in brute.substrings(rows)), key=str)


def test_marks_that_overlap_are_one():
    rng = np.random.default_rng(3)
    for n in (0, 1, 60):
        key, least = rng.integers(0, 4, n).astype(np.uint64), rng.integers(1, 4, n)
        offset, length = rng.integers(0, 60, n), rng.integers(1, 20, n)
        got = suffix.covered(key, offset.astype(np.uint8), length.astype(np.uint8), least)

        def bytes_of(key, offset, length, least):
            return {(k, d, b) for k, o, m, d in zip(key.tolist(), offset.tolist(), length.tolist(), least.tolist()) for b in range(o, o + m)}

        assert bytes_of(*got) == bytes_of(key, offset, length, least) and len(got[0]) <= n
        ends = sorted(zip(got[0].tolist(), got[3].tolist(), got[1].tolist(), (got[1].astype(int) + got[2]).tolist()))
        assert all(a[:2] != b[:2] or a[3] < b[2] for a, b in zip(ends, ends[1:])) and (np.diff(got[0].astype(int)) >= 0).all()


def test_owners_over_blocks(monkeypatch):
    """Windows have the same owners however a long text is cut."""
    rng = random.Random(7)
    text = bytes(rng.choice(b"ab cd") for _ in range(3000)) * 2

    def owner_of_windows():
        h, first, last = suffix.anchors(text)
        assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(text) - suffix.LEAST
        return np.repeat(h, last - first + 1).tolist()

    whole = owner_of_windows()
    for block in (64, 1000, 4096):
        monkeypatch.setattr(suffix, "BLOCK", block)
        assert owner_of_windows() == whole


def test_maximal_repeats_are_complete(monkeypatch):
    rng = random.Random(2)
    for turn in range(30):
        monkeypatch.setattr(suffix, "SORTED", 5 if turn % 2 else 200_000)
        pieces = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 20))) for _ in range(6)})
        found = {}
        for part in suffix.maximal_repeats(pieces, 4):
            for g, n, p, o in zip(*(x.tolist() for x in part)):
                found.setdefault(pieces[p][o : o + n], set()).add((p, o))
        where = {}
        for p, s in enumerate(pieces):
            for a in range(len(s)):
                for b in range(a + 4, len(s) + 1):
                    where.setdefault(s[a:b], set()).add((p, a))
        for s, places in where.items():
            right = {pieces[p][o + len(s)] if o + len(s) < len(pieces[p]) else -p - 1 for p, o in places}
            left = {pieces[p][o - 1] if o else -p - 1 for p, o in places}
            if len(places) > 1 and len(right) > 1 and len(left) > 1:
                assert found[s] == places
        assert all(where[s] == places for s, places in found.items())


# 9 --------------------------------------------------------------------------------------


def test_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 60)
    got = sorted(lm.score_texts(docs, rounds=2).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    for r, w in zip(got, sorted(brute.unigram(rows), key=lambda r: (r[0], r[2]))):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and abs(r.base_score - w[5]) < 1e-6 and math.isfinite(r.score)


def test_forward_and_expected_counts(monkeypatch):
    rng = np.random.default_rng(1)
    model = (rng.dirichlet([1, 1], 1), rng.dirichlet([1, 1], 2), rng.dirichlet(np.ones(lm.CLASSES), 2).T)
    texts = [rng.integers(0, lm.CLASSES, n).astype("<u2") for n in (1, 4, 6, 9, 3, 12)]

    def paths(ids):
        import itertools

        for z in itertools.product(range(2), repeat=len(ids)):
            p = model[0][0][z[0]] * model[2][ids[0], z[0]]
            for t in range(1, len(ids)):
                p *= model[1][z[t - 1], z[t]] * model[2][ids[t], z[t]]
            yield z, p

    got = lm.likelihoods([p.tobytes() for p in texts], model)
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(ids))) for ids in texts])
    f, m, e = np.zeros(2), np.zeros((2, 2)), np.zeros((2, lm.CLASSES))
    for ids in texts:
        every = list(paths(ids))
        total = sum(p for _, p in every)
        for z, p in every:
            f[z[0]] += p / total
            for a, c in zip(z, z[1:]):
                m[a, c] += p / total
            for a, c in zip(z, ids):
                e[a, c] += p / total
    for whole, stretch, size, some in ((512, 512, 400_000, 1000), (3, 3, 400_000, 1000), (4, 2, 7, 10), (1, 1, 5, 5), (8, 4, 20, 9)):  # whole texts and stretches, one pass and many
        for name, value in (("WHOLE", whole), ("STRETCH", stretch), ("PASS", size), ("SORTED", some)):
            monkeypatch.setattr(lm, name, value)
        first, moves, emits = (sum(x) for x in zip(*(lm.expected(*part, model) for part in lm.stretches([p.tobytes() for p in texts], model))))
        assert np.allclose(first, f) and np.allclose(moves, m) and np.allclose(emits, e)


def test_long_texts_are_trained_whole(monkeypatch):
    rng = np.random.default_rng(2)
    model = (rng.dirichlet(np.ones(8), 1), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(lm.CLASSES), 8).T)
    texts = [rng.integers(0, lm.CLASSES, n).astype("<u2").tobytes() for n in (20_000, 700, 30)]
    cut = [sum(x) for x in zip(*(lm.expected(*part, model) for part in lm.stretches(texts, model)))]
    monkeypatch.setattr(lm, "WHOLE", 1 << 20)
    whole = [sum(x) for x in zip(*(lm.expected(*part, model) for part in lm.stretches(texts, model)))]
    assert all(np.allclose(x, y) for x, y in zip(cut, whole))


def test_tail_classes_agree(spark):
    from pyspark.sql import functions as F

    words = [b"a", b"ab", b"abc", "çédille".encode(), b"x" * 40]
    got = spark.createDataFrame([(w,) for w in words], "word binary").select(F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(lm.TAIL)).alias("k")).collect()
    assert [lm.OWN + r.k for r in got] == [lm.tail_class(w) for w in words]


def test_model_beats_the_base_on_held_out_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = lm.score_texts(rows).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


# 10 -------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows):
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    c = duckdb.connect()
    c.register("documents", table)
    want = sorted(c.sql(mixing.ORACLE).fetchall(), key=str)
    got = collected(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken")
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    assert got == collected(mixing.mix(docs.repartition(5)), "doc_id", "size", "source_size", "target", "taken")


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 400}
    from radlake.llm.common import Scratch

    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark, "t")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], (1, 2, 3, 1, 2)))
    fixed, total = {}, sum(sizes.values())
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
    want = fixed | {s: level * w for s, w in free.items()}
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes)


# all --------------------------------------------------------------------------------------


def test_empty_tables(empty):
    for f in (packing.pack_documents, tokens.token_files, licenses.scan, minhash.near_duplicates, quality.quality, suffix.deduplicate, lm.score_texts, mixing.mix):
        assert f(empty).count() == 0, f


def test_rows_without_an_id(no_id):
    for f in (packing.pack_documents, tokens.token_files, licenses.scan, minhash.near_duplicates, quality.quality, suffix.deduplicate, lm.score_texts, mixing.mix):
        assert f(no_id).count() == 2, f


def test_pipeline(spark, docs, rows):
    from radlake.llm.common import Scratch

    scratch, now, steps = Scratch(spark, "test"), docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.save(stage(spark, now, ""), name)
        steps[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    good = [r for r in rows if not brute.quality(r[1])[5]]
    assert collected(steps["quality"], "doc_id", "text", "source") == sorted(good, key=str)
    groups = brute.components(good, 80)
    single = [r for r in dict.fromkeys(good) if groups[r[0]][1] == r[0]]
    assert collected(steps["near_dedup"], "doc_id", "text", "source") == sorted(single, key=str)
    cut = {x[0]: x[5].decode(errors="ignore") for x in brute.substrings(single)}
    assert collected(steps["suffix_dedup"], "doc_id", "text") == sorted(cut.items(), key=str)
    copies = {r.doc_id: r.copies for r in mixing.mix(steps["suffix_dedup"]).collect()}
    assert collected(steps["mixing"], "doc_id", "text") == sorted(((i, t) for i, t in cut.items() for _ in range(copies[i])), key=str)
    total = sum(len(brute.ids(t)) * copies[i] for i, t in cut.items())
    assert sum(r.length for r in steps["packing"].collect()) == total
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
