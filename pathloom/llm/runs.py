"""Periodic runs of words by a suffix automaton, and texts without the repetitions."""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.store import map_arrow, read_table, slices

#: A run has this many words and this many periods at least. Then words q apart are equal on 16 words or more in a row:
#: a run of length L and period q has L - q such words, and L - q >= max(24 - q, 2 q) >= 16.
LEAST_LENGTH, LEAST_POWER, WINDOW = 24, 3, 16
RUNS = "array<struct<start: long, length: long, period: long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as small integers, equal for equal words."""
    index: dict[bytes, int] = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))


def windows(ids: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW words from each place on, by doubling."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < WINDOW:
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9 + 2 * width) + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def repeated_regions(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches (start, stop) that have all runs of the words between them, each run whole.

    Each WINDOW words that come again d words later mark all from their start to the end of that next occurrence. The
    windows of a run come again within it, and these marks overlap from its start to its end. A stretch of r words has no
    run with a period above r / 3, so marks of larger d are taken away again. Equal hashes of unlike windows only mark more.
    """
    if len(ids) < LEAST_LENGTH:
        return []
    h = windows(ids)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    start, distance = order[:-1][same], (order[1:] - order[:-1])[same]
    most = np.full(len(start), len(ids) // LEAST_POWER)
    while len(start):
        keep = distance <= most
        start, distance = start[keep], distance[keep]
        edges = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + distance + WINDOW, -1)
        covered = np.concatenate(([0], (np.cumsum(edges) > 0).astype(np.int8)))
        turns = np.flatnonzero(np.diff(covered))
        starts, stops = turns[::2], turns[1::2]
        if keep.all():
            return [(a, b) for a, b in zip(starts.tolist(), stops.tolist(), strict=True) if b - a >= LEAST_LENGTH]
        most = (stops - starts)[np.searchsorted(starts, start, "right") - 1] // LEAST_POWER
    return []


def automaton(words: list[int]) -> tuple[array, array, array, int]:
    """The suffix automaton of the words: link, length and first end (-1 for clones) of each state, and their number.

    The first transition of a state stands in two arrays, as most states have no other; the rest in small dicts.
    """
    n = 2 * len(words) + 1
    key, to, link, length, end = (array("q", [x]) * n for x in (-1, -1, -1, 0, -1))
    more: dict[int, dict[int, int]] = {}
    last, count = 0, 1
    for at, c in enumerate(words):
        cur, p, q = count, last, -1
        count += 1
        length[cur], end[cur] = at + 1, at
        while p != -1:
            if key[p] == c:
                q = to[p]
                break
            if key[p] < 0:
                key[p], to[p] = c, cur
            else:
                rest = more.setdefault(p, {})
                if c in rest:
                    q = rest[c]
                    break
                rest[c] = cur
            p = link[p]
        if q < 0:
            link[cur] = 0
        elif length[p] + 1 == length[q]:
            link[cur] = q
        else:
            clone = count
            count += 1
            length[clone], key[clone], to[clone], link[clone] = length[p] + 1, key[q], to[q], link[q]
            if q in more:
                more[clone] = dict(more[q])
            while p != -1:
                if key[p] == c:
                    if to[p] != q:
                        break
                    to[p] = clone
                else:
                    rest = more.get(p)
                    if rest is None or rest.get(c) != q:
                        break
                    rest[c] = clone
                p = link[p]
            link[q] = link[cur] = clone
        last = cur
    return link, length, end, count


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.

    The ends of a state's words are merged from its children in the link tree, the smaller set into the larger. Two ends
    that become neighbours at a state of length n, d apart, share their last n words and no more; if d <= n they close a
    square, which starts where the run starts, and if 2 d <= n it has three periods. The last d words of a run give such a
    pair too, so the furthest end of a start and period is the run's end. Neighbours that a later child comes between
    are not taken: what lies between two neighbours of the whole set would be a smaller period.

    Sets keep ends negated, so a run, whose states come from its end to its start, appends. States of fewer than WINDOW
    words have no part in a run of LEAST_LENGTH.
    """
    link, length, end, count = automaton(words)
    lengths = np.frombuffer(length, np.int64)[:count]
    states = np.flatnonzero(lengths >= WINDOW)
    states = states[np.argsort(-lengths[states], kind="stable")]
    sets: dict[int, list[int]] = {}
    pairs: dict[int, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int], int] = {}
    for v in states.tolist():
        ends, n, up = sets.pop(v, None), length[v], link[v]
        if ends is None:
            ends = [-end[v]]
        for x, y in pairs.pop(v, ()):
            i = bisect_left(ends, x)
            if ends[i + 1] == y:
                d = y - x
                run = (-y - n + 1, d)
                if found.get(run, -1) <= -x:
                    found[run] = -x + 1
        n = length[up]
        if n < WINDOW:
            continue
        into = sets.get(up)
        if into is None:
            if end[up] < 0:
                sets[up] = ends
                continue
            into = [-end[up]]
        if len(into) < len(ends):
            into, ends = ends, into
        sets[up] = into
        for x in ends:
            i = bisect_left(into, x)
            if i and 2 * (d := x - into[i - 1]) <= n and n + d >= LEAST_LENGTH:
                pairs.setdefault(up, []).append((into[i - 1], x))
            if i < len(into) and 2 * (d := into[i] - x) <= n and n + d >= LEAST_LENGTH:
                pairs.setdefault(up, []).append((x, into[i]))
            into.insert(i, x)
    return sorted((start, stop - start, d) for (start, d), stop in found.items())


def text_runs(text: str | None) -> tuple[list[tuple[int, int, int]], bytes]:
    """All runs of a text's words, and its words but those that a run has after its first period, joined by one space."""
    words = text.encode("utf-8", "replace").split() if text else []  # splits at space and U+0009..U+000D, as WORD_BYTES does
    ids = numbered(words)
    found = [(a + start, length, period) for a, b in repeated_regions(ids) for start, length, period in runs_of(ids[a:b].tolist())]
    if not found:
        return [], b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return found, b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period: words from 0, by start, then period) and collapsed for every row of docs.

    A run is a stretch of LEAST_LENGTH words and LEAST_POWER smallest periods at least that can't be extended. collapsed is
    the text's words but for those that a run has after its first period, joined by one space. Null, empty and blank texts
    have no run and an empty text; rows without doc_id and repeated rows each keep their row; other columns are ignored;
    an empty table gives an empty result. Texts are whole; a text is worked on by one task, in memory proportional to it.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = [text_runs(t) for t in part.column(1).to_pylist()]
                runs = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r, _ in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                yield pa.RecordBatch.from_arrays([part.column(0), runs, pa.array([t.decode() for _, t in found], pa.string())], ["doc_id", "runs", "collapsed"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, runs {RUNS}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document by the hash of its id repeats words from some place on to its end.

    With h the CRC-32 of the decimal id and g = h / 10, words from a = g % n on become the first p of them, again and again;
    p = 1 + (n - a) / (3 + g % 8). Rows without doc_id, and texts without words, stay as they are.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(chosen, words).alias("w"), F.floor(h / 10).alias("g"))
    at = at.select("doc_id", "text", "w", "g", (F.col("g") % F.size("w")).cast("int").alias("a"))
    at = at.withColumn("p", F.expr("cast(1 + floor((size(w) - a) / (3 + g % 8)) as int)"))
    turned = F.expr("concat_ws(' ', slice(w, 1, a), transform(sequence(a, size(w) - 1), i -> w[a + (i - a) % p]))")
    return at.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(turned).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run of most periods (ties: the first, then the
    smallest period), runs_sha256, collapsed_sha256 over the whole of documents with loops put in."""
    found = periodic_runs(looped(read_table(spark, sf_dir, "documents")))
    more = "case when x.length * y.period <> y.length * x.period then x.length * y.period > y.length * x.period else (x.start, x.period) < (y.start, y.period) end"
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 1)), runs[0], (y, x) -> if({more}, x, y))")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
