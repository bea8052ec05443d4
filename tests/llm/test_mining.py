"""Hard negatives, decontamination and the divergence audit against plain versions, on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from radlake.llm import contamination, divergence, mining
from radlake.llm.common import Scratch

from . import brute

# 11 -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, key long, score string, width string, tile string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "s", "w", "t") for i, v, label in rows], VECTORS)


def plain_negatives(rows):
    """rows: (vec_id, vector, label), one per id."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(256 * x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, list(v))
        good[i] = min(good.get(i, row), row)
    ints = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in good.items()}
    clip = lambda s: max(mining.LEAST, min(mining.MOST, s))
    out = []
    for a, (label, v) in ints.items():
        if a % 100:
            continue
        every = sorted((-clip(sum(x * y for x, y in zip(v, w))), i, own) for i, (own, w) in ints.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in every if x[2] == label][:5]:
            some = [x for x in every if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(some)]
    return sorted(out)


def near(rng, n, width=12, centres=6):
    """Vectors about a few centres, with many equal ones."""
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in middle[rng.randrange(centres)]], rng.randrange(3)) for i in range(n)]
    return [(i, middle[0], label) if i % 3 == 1 else (i, v, label) for i, v, label in rows]


@pytest.mark.parametrize("tile_bytes", [4 << 20, 3000])
def test_hard_negatives(spark, tile_bytes, monkeypatch):
    rng = random.Random(11)
    rows = near(rng, 900)
    rows += [(None, [1.0] * 12, 1), (1001, None, 1), (1002, [1.0] * 12, None), (1003, [None] * 12, 1), (1004, [float("nan")] * 12, 1), (1005, [float("inf")] * 12, 1), (1006, [1e308] * 12, 1)]
    rows += [(2000, [0.0] * 12, 1), (2001, [], 1), (2100, [], 1), (2102, [], 2), (2200, [1.0, 2.0], 0), (2201, [1.0, 1.0], 0), (2202, [0.5, 0.5], 1), (100, [9.0] * 12, 9), rows[200]]
    monkeypatch.setattr(mining, "PACK", 3)
    got = sorted(tuple(r) for r in mining.hard_negatives(vectors(spark, rows).repartition(3), tile_bytes=tile_bytes).collect())
    assert got == plain_negatives(rows) and len(got) > 100


def test_brackets_rule_rows_out_and_change_nothing(spark):
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.standard_normal((400, 16)) for c in rng.standard_normal((8, 16))]))
    m2 = float((x * x).sum(axis=1).max())
    pivots = mining.choose(x, m2)
    dist = np.ascontiguousarray(mining.distances(mining.augmented(x, m2), pivots).T)
    left = 0
    for q in x[::97]:
        own = mining.distances(np.concatenate([q, [0.0]])[None, :], pivots)[0]
        score = x @ q
        floor, ceiling = np.sort(score)[-5], score.max()
        at = mining.survivors(dist, own, np.arange(len(x)), float(q @ q), m2, floor, ceiling)
        assert set(np.flatnonzero(score >= floor)) <= set(at)
        left += len(at)
    assert left < 0.3 * len(x) * len(x[::97])


def test_scores_beyond_doubles(spark):
    rows = [(100 * k, [2.0**20 + k / 256, 1.0], k % 2) for k in range(6)] + [(k, [2.0**20 * (1 + k / 50) + k / 256, 1.0 / 256], k % 2) for k in range(1, 40)] + [(600, [2.0**60, 1.0], 0), (601, [-(2.0**60), 1.0], 1)]
    got = sorted(tuple(r) for r in mining.hard_negatives(vectors(spark, rows)).collect())
    assert got == plain_negatives(rows) and got


def test_no_vectors(spark):
    assert mining.hard_negatives(vectors(spark, [])).count() == 0
    assert mining.hard_negatives(vectors(spark, [(None, None, None), (7, [1.0], 1)])).count() == 0


# 12 -------------------------------------------------------------------------------------

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(brute.LOWER))


def plain_hits(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, own = item_words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (s := tuple(w[k : k + m])) in windows:
                    hit |= set(range(k, k + m))
                    own |= windows[s] - {None}
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit)))
    return out


def planted(rng):
    pool = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(rng.randint(10, 40))) for k in range(30)] + [(40, "Just three-words"), (41, "one"), (42, None), (43, " .,- "), (None, text(20)), (9, text(15)), (10, items_text := "same same " * 12), (11, items_text), (12, "É a B é")]
    docs = [(k, f"{text(rng.randint(0, 30))}\n{rng.choice(items)[1] or ''}! {text(rng.randint(0, 30))}".upper() if k % 3 else text(50)) for k in range(80)]
    docs += [(100, None), (101, ""), (102, "same " * 200), (103, "JUST-THREE, words"), (None, items[0][1]), (104, " ".join(t or "" for _, t in items * 3)), (105, "É A b É é a b É"), docs[1]]
    return docs, items


@pytest.mark.parametrize("slice_words, block", [(200_000, 1 << 20), (60, 64)])
def test_decontamination(spark, slice_words, block):
    docs, items = planted(random.Random(12))
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, digest string, item_id string").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = contamination.decontaminate(d, b, slice_words=slice_words, block=block).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(plain_hits(docs, items), key=str)
    assert all(sum(s.n_words for s in r.spans) == r.n_hit for r in found)


def test_words_do_not_depend_on_blocks():
    text = ("Ab-cé9 " * 50 + "x" * 300 + " . " + "yz " * 20).encode()
    want = [w.encode() for w in item_words(text.decode())]
    for block in (1, 2, 7, 64, 1 << 20):
        assert [w for words in contamination.words_of(text, block) for w in words] == want


def test_shifts_skip_places():
    strings = contamination.Strings(10)
    strings.add([f"a{k}".encode() for k in range(10)], "i")
    assert strings.shift[b"a8 a9"] == 0 and strings.shift[b"a0 a1"] == 8 and strings.most == 9
    assert list(strings.occurrences([b"z"] * 33 + [f"a{k}".encode() for k in range(10)] + [b"z"] * 5)) == [(33, {"i"})]


def test_no_documents_or_items(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.decontaminate(none, items).count() == 0
    got = contamination.decontaminate(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), items.limit(0)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in got) == [(0, 0, 0, False), (1, 2, 0, False)]


# 13 -------------------------------------------------------------------------------------


def plain_audit(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        held, all_n, by = Counter(), Counter(), defaultdict(Counter)
        for w, own, s in docs:
            if own == lang:
                held.update(set(w))
                all_n.update(w)
                by[s].update(w)
        kept = sorted(t for t, n in held.items() if n >= least)
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        ps, q = {s: p_of(c) for s, c in by.items()}, p_of(all_n)
        for s, p in ps.items():
            pairs = sorted((-sum(f(p[t], other[t]) for t in kept), o.encode()) for o, other in ps.items() if o != s)
            terms = sorted((-f(p[t], q[t]), t.encode()) for t in kept if by[s][t] and p[t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def spoken(rng):
    pool = ["".join(rng.choice("aábc\U0001f600ﬀ") for _ in range(rng.randint(1, 5))) for _ in range(120)] + ["long" * 200 + c for c in "abcdefghijkl"]
    rows = [(" ".join(rng.choices(pool, k=rng.randint(0, 60))) + "1X.x", rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "hot", "a", "b", "ñ", None])) for _ in range(400)]
    rows += [(None, "en", "silent"), ("", "xx", "y"), ("rare", "xx", "z"), ("only one", "yy", "alone")] + [rows[0]] * 15
    return rows + [(" ".join(pool), "tie", "s")] * 12 + [("plain words", "tie", "t")] * 12


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, small, monkeypatch):
    rows = spoken(random.Random(13))
    if small:
        for name, value in (("HELD", 20), ("BUCKET", 40), ("SOURCES", 2), ("BLOCK", 16)):
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(divergence.top_values, "__defaults__", (2,))
    docs = spark.createDataFrame([(k % 7, t, lang, s, "x", 1, 2) for k, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, k int, n long").repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain_audit(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_radix_selection(spark):
    rng = random.Random(4)
    rows = {(g, "s", "".join(rng.choice("abé") for _ in range(rng.randint(1, 9))), rng.choice([0, 5, 5, 5, 2**20, 2**29 + 3, 10**9])) for g in "xyz" for _ in range(500)}
    rows = list({(g, s, t): (g, s, t, v) for g, s, t, v in rows}.values()) + [("few", "s", "t", 0)]
    values = spark.createDataFrame(rows, "lang string, source string, term string, value long")
    for top in (1, 10, 70, 170):
        got = divergence.top_values(values, top, Scratch(spark, "radix"), few=3).collect()
        want = []
        for g in {r[0] for r in rows}:
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[2].encode()))[:top]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_sums_beyond_longs(spark):
    row = spark.range(1).selectExpr("9000000000000000 AS n", "9100000000000000 AS total", "5L AS terms").selectExpr(f"{divergence.share('n', 'total', 'terms')} AS p").head()
    assert row.p == 1 + 10**9 * (9 * 10**15 + 2) // (91 * 10**14 + 10)


@pytest.mark.parametrize("name", ["op11_negatives", "op12_decontamination", "op13_divergence"])
def test_query_equals_its_sql(spark, name):
    from radlake.llm import queries

    where = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    found = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    got = queries.QUERIES[name](spark, where)
    assert sorted(got.columns) == sorted(names)
    assert want and sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[n] for n in got.columns) for r in want)
