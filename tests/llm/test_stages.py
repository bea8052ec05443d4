"""Stages of the pipeline and operators on planted rows."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from radlake.llm import licenses, mixing, quality, suffix, tokens
from radlake.llm.common import Scratch

from . import brute


def test_near_dedup_links_from_80(spark):
    rng = random.Random(31)
    pool = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(12):  # three words changed, far apart: 141 of 171 shingles are common, 0.82
        w = [rng.choice(pool) for _ in range(160)]
        rows.append((2 * i, " ".join(w), "s"))
        for at in (20, 70, 120):
            w[at] = f"z{i}x{at}"
        rows.append((2 * i + 1, " ".join(w), "s"))
    sets = {i: brute.shingles(t) for i, t, _ in rows}
    assert all(0.80 < len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) < 0.85 for k in range(0, 24, 2))
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 24, 2))


def test_long_lines_count(spark):
    notice = " ".join(f"term{k}" for k in range(40))
    clean = lambda k: " ".join(f"own{k}x{n}" for n in range(30))
    rows = [(k, f"page {k}\n{notice}", "h") for k in range(60)] + [(100 + k, f"{clean(k)}\n{notice}", "h") for k in range(5)] + [(200 + k, f"{notice}\npage {k}", "few") for k in range(40)]
    got = {r.doc_id: (r.kept, r.n_left) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k] == (False, 2) for k in range(60)) and all(got[100 + k] == (True, 30) for k in range(5)) and all(got[200 + k] == (True, 42) for k in range(40))


def plain_quality(rows, limit=50):
    """doc_id -> (kept, words left) by documents and texts that hold a line; rows: (doc_id, text, source)."""
    docs, texts = {}, {}
    lines = lambda t: [" ".join(x.translate(brute.LOWER).split()) for x in t.split("\n") if x.split()]
    for i, t, s in rows:
        for x in lines(t):
            docs.setdefault((s, x), set()).add((i, t))
            texts.setdefault((s, x), set()).add(t)
    out = {}
    for i, t, s in rows:
        n = len(t.split())
        every = sum(len(x.split()) for x in lines(t) if len(docs[s, x]) > limit)
        strong = sum(len(x.split()) for x in lines(t) if len(texts[s, x]) > limit)
        short = lambda k: n - k < 20 or 100 * (n - k) < 20 * n
        lost = strong if short(every) and not short(strong) else every
        out[i] = (not brute.quality(t)[5] and not (strong and short(strong)), n - lost)
    return out


def test_lines_are_counted_by_documents(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    copied = f"{words('copy', 12)}\n{words('more', 14)}"
    menu = words("menu", 16)
    rows = [(k, copied, "h") for k in range(1000)] + [(2000 + k, f"{copied}\n{words(f'near{k}x', 5)}", "h") for k in range(3)]  # copies are no boilerplate
    rows += [(3000 + k, f"{menu}\n{words(f'base{k % 3}x', 40)}", "m") for k in range(60)]  # one menu on 60 documents of three texts
    rows += [(4000 + k, f"{menu}\n{words(f'base{k}x', 6)}", "n") for k in range(60)] + [(5000 + k, f"{menu}\n{words(f'own{k}x', 6)}", None) for k in range(50)]
    got = {r.doc_id: (r.kept, r.n_left) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == plain_quality(rows)
    assert got[0] == (True, 26) and got[2000] == (True, 31) and got[3000] == (True, 40) and got[4000] == (False, 6) and got[5000] == (True, 22)


def test_quality_agrees_with_its_sql(spark):
    import duckdb
    import pyarrow as pa

    rng = random.Random(3)
    pool = ["\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 18))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = [(k % 300, rng.choice(pool) + (f"\nrow {k} " * rng.randint(0, 3)), rng.choice(["a", "b", None])) for k in range(600)]
    rows = list(dict.fromkeys(rows))
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = sorted(c.sql(quality.ORACLE).fetchall())
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = sorted(tuple(r) for r in quality.quality(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept").collect())
    assert got == want and {r[-1] for r in got} == {True, False}


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    a, b, c, d = words(80), words(90), words(70), words(60)
    rows = [(1, a, "s", "x"), (2, a + " tail " + d, "s", "x"), (2, b, "s", "y"), (2, b, "s", "x"), (3, c, "s", "x"), (3, a, "s", "x"), (None, d, "s", "x"), (4, None, "s", "x"), (4, None, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cut = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.deduplicate(docs.filter("doc_id IS NOT NULL")).collect())
    assert cut == sorted((x[0], x[1], x[2], x[4]) for x in brute.substrings([r for r in rows if r[0] is not None]))
    for n in (1, 3, 7):
        left = corpus_pipeline.near_duplicates(spark, docs.repartition(n), "").collect()
        assert sorted(map(tuple, left), key=str) == sorted([rows[0], rows[1], rows[3], rows[4], rows[6], rows[7]], key=str)


def test_mixing_of_rows_without_an_id(spark):
    rows = [(None, f"text {k} " + "word " * (k % 7), "abc"[k % 3]) for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 20


def test_read_back_uses_a_task_for_each_file(spark):
    docs = spark.createDataFrame([(k, f"some text {k} " * 20) for k in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokens.write_tokens(docs, Scratch(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = tokens.read_tokens(manifest)
    assert manifest.count() > 1 and back.rdd.getNumPartitions() == manifest.count() and back.count() == 400
    assert manifest.first().path.startswith("file:/")


def test_scratch_takes_a_relative_folder(spark, monkeypatch, tmp_path):
    scratch = Scratch(spark, "t")
    scratch.path = "relative/folder"
    assert scratch.uri("x").startswith("file:/") and scratch.uri("x").endswith("/relative/folder/x")


def test_quality_stage_cuts_frequent_lines(spark):
    own = lambda k: " ".join(f"Ówn{k}x{n}" for n in range(30))
    rows = [(k, f"Home  About\n\n{own(k)}\nhome about\n© all rights reserved by the site", "h", 1) for k in range(60)] + [(100, f"Home About\n{own(100)}", "other", 1)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string, n_chars int")
    left = corpus_pipeline.quality_rules(spark, docs, "")
    want = [(k, f"\n{own(k)}", "h", len(own(k)) + 1) for k in [*range(60), 0]] + [(100, rows[60][1], "other", len(rows[60][1]))]
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(want)


def test_licenses_over_lines():
    matcher = licenses.Matcher({})
    scan = lambda t: {(b["label"], b["containment"]) for b in licenses.scan_text(t.encode(), matcher)[7]}
    for label, text in licenses.TEMPLATES:
        w = text.split()
        wrapped = "\n".join(" * " + " ".join(w[k : k + 3]) for k in range(0, len(w), 3))
        assert (label, 1.0) in scan(f"some code\n{wrapped}\nmore") and (label, 1.0) in scan("word " * 5000 + text + " word" * 5000)
    far = " other words".join(f"{' filler' * 40} {w}" for w in ("released", "under", "the", "mit", "license"))
    assert not scan(far)
    twice = licenses.scan_text(("Released under the MIT License. " + "x " * 60).encode() * 2, matcher)[7]
    assert [(b["block"], b["label"]) for b in twice] == [(0, "mit-notice"), (65, "mit-notice")]


def test_license_runs_are_exact():
    rng = random.Random(6)
    pool = sorted(frozenset().union(*(t for _, t in licenses.templates()))) + [b"zz", b"yy", b"xx"] * 20
    for _ in range(60):
        words = []
        for _ in range(8):
            part = rng.choice(licenses.TEMPLATES)[1].encode()
            words += [w if rng.random() < 0.85 else rng.choice(pool) for w in licenses.words_of(part)] + rng.choices(pool, k=rng.randint(0, 60))
        matcher = licenses.Matcher({w: rng.randint(0, 50) for w in pool})
        got = {}
        for _, label, share in matcher.runs(words):
            got[label] = max(share, got.get(label, 0))
        want = {}
        for (label, own, need), n in zip([(x, s, -(-4 * len(s) // 5)) for x, s in licenses.templates()], matcher.length):
            most = max(len(own.intersection(words[k : k + n])) for k in range(len(words)))
            if most >= need:
                want[label] = most / len(own)
        assert got == want


def test_a_long_repetitive_text_is_linear():
    import time

    matcher = licenses.Matcher({})
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        row = licenses.scan_text(b"MIT license " * n, matcher)
        took.append(time.process_time() - began)
        assert row[:4] == (2 * n, n, 0, 2 * n - 2)
    assert took[1] < 8 * took[0]  # 16 times if every place were counted from the start


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("house", "All rights stay with the house of Example"), ("none", " . "), (None, "x y"), ("house", "All rights stay with the house of Example")], "label string, text string")
    docs = spark.createDataFrame([(1, "so all rights stay\nwith the house of example here"), (2, "Released under the MIT License.")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, table=table).collect()}
    assert got == {1: ("house", 1.0), 2: ("mit", 0.5)}
    assert {r.labels for r in licenses.scan(docs, table=table.limit(0)).collect()} == {"", "mit"}


def test_ids_that_repeat_are_several_files(spark):
    rows = [(None, f"text {k} " * 40) for k in range(300)] + [(5, f"other {k} " * 40) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokens.write_tokens(docs, Scratch(spark, "hot"))
        assert manifest.count() == 4 and max(r.n_docs for r in manifest.collect()) < 400
        got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(manifest).collect()), key=lambda r: r[1])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r[0] for r in got] == [None] * 300 + [5] * 300 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert sorted(r[3] for r in got) == sorted(brute.crc(brute.ids(t)) for _, t in rows)


def test_copies_that_are_not_spared(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(k, f"{words('copy', 12)}\n{words('more', 14)}", "h") for k in range(60)] + [(100, words("own", 30), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = lambda **more: {r.doc_id for r in quality.quality(docs, **more).filter("kept").collect()}
    assert kept() == {*range(60), 100} and kept(spare_copies=False) == {100}


def test_stages_on_empty_tables_and_rows_without_ids(spark, docs, empty, no_id):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        out = stage(spark, no_id, "")
        assert out.count() >= (0 if name == "quality" else 1), name
        if name != "packing":
            assert out.columns == no_id.columns
