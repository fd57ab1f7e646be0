"""Periodic runs against brute force, and the edges of its inputs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import tarn.llm.catalogue as catalogue
from tarn.llm import periodic
from tarn.runtime import table


def brute(words, least=24, times=3):
    """Every distance is tried at every place."""
    smallest = {}
    for q in range(1, len(words) // times + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, times * q):
                smallest.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted(((a, n, q) for (a, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    out = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in out]


def test_runs_as_by_brute_force():
    r = random.Random(5)
    seen = 0
    for _ in range(1500):
        n, k = r.randrange(100), r.choice([1, 2, 3, 5, 30])
        s = [r.randrange(k) for _ in range(n)]
        if s and r.random() < 0.7:
            a, p = r.randrange(n), r.randrange(1, 9)
            s = s[:a] + [s[min(a + (i - a) % p, n - 1)] for i in range(a, n)]
        least, times = r.choice([(24, 3), (24, 3), (4, 2), (9, 4)])
        got = [tuple(x) for x in periodic.runs_of(np.array(s, dtype=np.int64), least, times).tolist()]
        assert got == brute(s, least, times)
        seen += len(got)
    assert seen > 500


def test_z_function():
    for text in ("", "a", "aaaa", "abacabad", "abababab"):
        s = np.array([ord(c) for c in text], dtype=np.int64)
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s).tolist() == want


def test_query(spark, sf_dir):
    want = {}
    for d, text in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w) if n < 3000 else [tuple(x) for x in periodic.runs_of(np.unique(w, return_inverse=True)[1]).tolist()]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        want[d] = (len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(collapsed(w, runs)))))
    got = {r[0]: tuple(r)[1:] for r in catalogue.op11_periodic_runs(spark, sf_dir).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 5


def test_edges(spark):
    loop = "x y z " * 10
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, loop), (4, loop), (None, loop), (5, "a " * 24), (6, "a " * 23), (7, "A a " * 12), (8, "a b " * 30)]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, runs string, n_words int")
    got = {}
    for r in periodic.collapse_runs(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.text))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(30, [(0, 30, 3)], "x y z")] * 2 and got[None] == got[4][:1]
    assert got[5] == [(24, [(0, 24, 1)], "a")] and got[6][0][1] == [] and got[6][0][2] == " ".join("a" * 23)
    assert got[7] == [(24, [(0, 24, 2)], "A a")] and got[8] == [(30, [(0, 30, 1)], "a b")]
    assert periodic.collapse_runs(df.limit(0)).count() == 0
    assert catalogue.planted_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(df, times=1)


def test_bytes_and_long_texts(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(concat(repeat(cast(unhex('61FF20') as string), 30), 'end') as string) AS text")
    r = periodic.collapse_runs(df).select("n_words", "runs", "text", "doc_id").first()
    assert r.n_words == 31 and [tuple(x) for x in r.runs] == [(0, 30, 1)]
    big = spark.createDataFrame([(1, " ".join(str(i % 50_000) for i in range(200_000)))], "doc_id long, text string")
    r = periodic.collapse_runs(big).first()
    assert [tuple(x) for x in r.runs] == [(0, 200_000, 50_000)] and len(r.text.split()) == 50_000
