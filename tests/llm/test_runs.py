"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

from pathloom.llm.runs import looped, op13_runs, periodic_runs, repeated_regions, text_runs
from pathloom.llm.words import words

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """Each period in turn: stretches of words equal to those q on; periods that a smaller one divides are left out."""
    found = []
    for q in range(1, len(w) // 3 + 1):
        same, k = [a == b for a, b in zip(w, w[q:], strict=False)], 0
        while k < len(same):
            if not same[k]:
                k += 1
                continue
            j = k
            while j < len(same) and same[j]:
                j += 1
            part = w[k : j + q]
            if len(part) >= max(24, 3 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((k, len(part), q))
            k = j
    return sorted(found)


def digests(doc_id, text):
    """The contract, word by word."""
    w = words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *row, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_runs_against_brute_force():
    pick = random.Random(3)
    for _ in range(500):
        w, most = [], pick.choice([10, 60, 250])
        while len(w) < most:
            w += [str(pick.randrange(pick.choice([1, 2, 3, 40]))) for _ in range(pick.randint(1, 18))] * pick.randint(1, 6)
        found, kept = text_runs(" ".join(w))
        assert found == plain_runs(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        assert kept.decode().split() == [x for i, x in enumerate(w) if i not in gone]


def test_limits_of_a_run():
    twelve = [f"w{i}" for i in range(12)]
    assert text_runs(" ".join(twelve * 3))[0] == [(0, 36, 12)]
    assert text_runs(" ".join((twelve * 3)[:-1]))[0] == []  # less than three periods
    assert text_runs("a " * 23)[0] == []
    assert text_runs("a " * 24)[0] == [(0, 24, 1)]


def test_regions_have_few_words_of_a_text_without_runs():
    import numpy as np

    pick = random.Random(4)
    w = [pick.randrange(1000) for _ in range(5000)]
    w[3000:3100] = w[100:200]  # a passage that comes again, too far off for a run of the stretch between
    w[4000:4300] = (w[4000:4010]) * 30
    assert repeated_regions(np.array(w)) != [(0, 5000)]
    assert (4000, 4300) in [(a, b) for a, b in repeated_regions(np.array(w)) if a >= 3990]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = tuples(op13_runs(spark, SF))
    assert found == sorted((digests(r.doc_id, r.text) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in found) > 10


def test_hard_rows(spark, corpus):
    """Null ids and texts, blank and long texts, repeated rows, clashing names, no rows."""
    rows = [*corpus, (None, "a b " * 30), (7, None), (-3, "x " * 50), (14, corpus[7][1])]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    found = periodic_runs(looped(docs))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(((r.doc_id, len(r.runs), digest(r.collapsed)) for r in found.collect()), key=repr)
    assert got == sorted(((d[0], d[1], d[-1]) for d in (digests(i, t) for i, t in rows)), key=repr)
    assert periodic_runs(looped(docs.limit(0))).collect() == []


def test_one_very_long_text(spark):
    text = "w " * 300_000 + " ".join(f"u{i}" for i in range(100_000)) + " z y" * 100_000
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 1), (400_000, 200_000, 2)]
    assert len(row.collapsed.split()) == 100_003
