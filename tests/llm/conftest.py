import random

import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, h string, digest string, bucket string, blob string, target string, copies string, held string, _d long, _salt int, component string"


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def texts():
    """Texts with copies, near copies, shared passages, repeats, odd characters, a long one, empty ones and null."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdeéfghıj") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = words(rng, 160, pool)
    out = [base, base, None, "", " \n\t ", "one", "One", "a b c", "Ünï cödé 世界 " * 12, "x" * 300, "MIT License and the General  Public\nLicense.", "Released under the MIT License.\nhello"]
    out += ["the mit-license, apache license; apache License", "<|endoftext|> and 's <|startoftext|>x", "\x00\x01 \x0b a\x0cb\x85c d e"]
    for edits in (1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(pool) + "z"
        out.append(" ".join(w))
    passage = words(rng, 30, pool)
    out += [words(rng, 40, pool) + "\n" + passage + "\n" + words(rng, 25, pool) for _ in range(8)]
    out += ["\n".join(["boiler plate line"] * 3 + [words(rng, 30, pool)]) for _ in range(4)]
    out += [words(rng, 3000, pool), words(rng, 3000, pool[:50]), "same words here " * 30, base.upper()]
    out += [words(rng, rng.randint(20, 120), pool) for _ in range(20)]
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): shuffled ids, sources of uneven size, one row twice."""
    got = texts()
    ids = list(range(3, 3 + len(got)))
    random.Random(1).shuffle(ids)
    made = [(i, t, None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 5}") for k, (i, t) in enumerate(zip(ids, got))]
    return made + [made[5]]


def frame(spark, rows):
    filler = lambda i: ("en", 1, 9, "h", "d", "b", "x", "t", "c", "e", 1, 2, "k")
    return spark.createDataFrame([(i, t, s, *filler(i)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="session")
def no_id(spark):
    return frame(spark, [(None, "a text without an id that is long enough to be looked at, and again a text without an id", None), (1, None, None)]).cache()
