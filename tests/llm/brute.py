"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from radlake.llm import tokens

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKENIZER = []


def ids(text):
    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(tokens.default_tokenizer()))
    return np.array(_TOKENIZER[0].encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def crc(x):
    return zlib.crc32(np.asarray(x, "<u4").tobytes())


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(x), find(i)) for i, x in sets}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def substrings(rows, least=50):
    """n_bytes, n_removed, n_spans, sha256 and the bytes left, for each row."""
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            first.setdefault(b[p : p + least], i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        keep = bytearray([1]) * len(b)
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                keep[p : p + least] = bytes(least)
        left = bytes(c for c, k in zip(b, keep) if k)
        spans = sum(not keep[p] and (p == 0 or keep[p - 1]) for p in range(len(b)))
        out.append((i, len(b), len(b) - sum(keep), spans, hashlib.sha256(left).hexdigest(), left))
    return out


def unigram(rows):
    words = [(i, WORD.findall((t or "").translate(LOWER)) + [None], zlib.crc32(str(i).encode()) % 5 == 1) for i, t, *_ in rows]
    c = Counter(x for _, w, held in words if not held for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w, held in words]
