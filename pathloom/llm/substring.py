"""Substring dedup: winnowed anchors are the seeds, matches are extended around them, repeats that are long enough go.

A window is `window` consecutive words of a document. Winnowing picks an anchor in each window by its content alone, so
equal windows pick equal anchors. The windows that pick the same anchor lie side by side; the words under them are the
anchor's span, as far to the left and right of the seed as its windows go. Documents meet on anchors:

1. Occurrences of an anchor with equal spans match over the whole span: all but the first are repeats.
2. Where spans of one anchor differ, the first occurrence of each is extended window by window against the others.

What is marked is merged into maximal runs of words. The outcome is that of comparing all windows with each other, but
only an anchor in about window / 2 words is shuffled, and windows only where spans differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.store import free_prefix, map_arrow, map_columns, materialize, quoted, read_table, slices
from pathloom.llm.words import WORD, WORD_BYTES

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
NO_ID = -(1 << 63)  # stands for a null doc_id; before all others


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@lru_cache(4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, factor, U)
        x[0] = 1
        out.append(np.cumprod(x, dtype=U))
    return out[0], out[1]


class WordHashes:
    """Hashes of any run of a document's words, by prefix sums."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, words), U, self.n)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def runs(self, start: np.ndarray, length, base: int = BASES[0]) -> np.ndarray:
        if base not in self.sums:
            up, down = _powers(base, 1 << max(10, self.n.bit_length()))
            self.sums[base] = np.concatenate((np.zeros(1, U), np.cumsum(self.words * up[: self.n], dtype=U))), down
        sums, down = self.sums[base]
        return mix((sums[start + length] - sums[start]) * down[start])


def anchor_spans(hashes: WordHashes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, span hash, first window, number of windows) of each anchor of a document."""
    if hashes.n < window:
        return (np.empty(0, U),) * 2 + (np.empty(0, np.int64),) * 2
    grams = hashes.runs(np.arange(hashes.n - anchor + 1), anchor)
    choice = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)
    step = 1 << 16  # bounds the memory for very long texts
    pick = np.concatenate([choice[i : i + step, ::-1].argmin(axis=1) for i in range(0, len(choice), step)])
    place = np.arange(len(choice)) + (window - anchor) - pick  # the rightmost of equals
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, len(place)))
    span = hashes.runs(first, count + window - 1, BASES[1])
    span = mix(span + U(0x9E3779B97F4A7C15) * (count * 4096 + place[first] - first).astype(U))
    return grams[place[first]], span, first, count


def pack_at(position: np.ndarray, count) -> np.ndarray:
    """position and number of windows in one sortable integer."""
    return (position.astype(np.int64) << 8) | count


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


#: A window or an anchor's span: marked as a repeat or not, 128 bits of its words, and its document's doc_id, place, and 64 bits of
#: its document's text. doc and text together are the document: rows of one doc_id, or of none, are told apart by their texts.
NAMES = ["repeat", "a", "b", "doc", "at", "text"]
SCHEMA = "repeat boolean, a long, b long, doc long, at long, text long"


def to_batch(repeat: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (repeat, *columns)], NAMES)


def firsts(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
    """A batch's rows with those that aren't the first of their key (a, b) marked as repeats: the combination ahead of
    the shuffle. Marked rows need no key any more and get one of their own place, so that they are dealt evenly."""
    order = np.lexsort((text, at, doc, b, a))
    a, b, doc, at, text = (x[order] for x in (a, b, doc, at, text))
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    copy = ~new  # a row of the table that is there twice
    for x in (doc, at, text):
        copy[1:] &= x[1:] == x[:-1]
    repeat = ~new & ~copy
    a = np.where(repeat, signed(mix(doc.view(U) + mix(text.view(U) + mix(at.view(U))))), a)
    b = np.where(repeat, 0, b)
    keep = ~copy
    return to_batch(*(x[keep] for x in (repeat, a, b, doc, at, text)))


def mark(batches: Iterator[pa.RecordBatch], leaders: bool) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by NAMES and holds one row only from batch to batch.

    Yields the repeats: marked rows, and all that aren't the first of their (a, b). leaders: yields also, unmarked, the
    first rows of each (a, b) whose a has several b.
    """
    last = first = None  # (a, b) before, and (doc, at, text, waiting) of the first row of it
    for batch in batches:
        if not batch.num_rows:
            continue
        done, *rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        done = done.astype(bool)
        if done.any():
            yield to_batch(np.ones(done.sum(), bool), *(x[done] for x in rows))
            rows = [x[~done] for x in rows]
        a, b, *places = rows
        n = len(a)
        if not n:
            continue
        same_a = np.concatenate(([last is not None and a[0] == last[0]], a[1:] == a[:-1]))
        same_b = same_a & np.concatenate(([last is not None and b[0] == last[1]], b[1:] == b[:-1]))
        start = np.maximum.accumulate(np.where(~same_b, np.arange(n), -1))
        before, other = start < 0, np.zeros(n, bool)
        for i, x in enumerate(places):
            other |= x != (np.where(before, first[i], x[start]) if before.any() else x[start])
        later = same_b & other
        if later.any():
            yield to_batch(np.ones(later.sum(), bool), *(x[later] for x in rows))
        heads = np.flatnonzero(~same_b)
        if leaders and len(heads):
            if same_a[heads[0]] and first is not None and first[3]:  # the one that waits has company
                yield to_batch(np.zeros(1, bool), *(np.array([x], np.int64) for x in (*last, *first[:3])))
            shared = same_a[heads]
            shared[:-1] |= same_a[heads[1:]]
            found = heads[shared]
            if len(found):
                yield to_batch(np.zeros(len(found), bool), *(x[found] for x in rows))
            first = (*(int(x[heads[-1]]) for x in places), not shared[-1])
        elif len(heads):
            first = (*(int(x[heads[-1]]) for x in places), False)
        last = (a[-1], b[-1])


def deal_and_mark(rows: DataFrame, leaders: bool) -> DataFrame:
    dealt = rows.repartition("a").sortWithinPartitions(*NAMES)
    return map_arrow(dealt, lambda batches: mark(batches, leaders), SCHEMA)


def doc_key() -> list:
    """doc and text hash, which tell documents apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")]


def gathered(make: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs make on each row (as tuples) and combines what it gives for a batch."""
    for batch in batches:
        parts = [x for part in slices(batch, 2) for row in zip(*(c.to_pylist() for c in part.columns), strict=True) if (x := make(*row)) is not None]
        if parts:
            yield firsts(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def find_repeats(docs: DataFrame, window: int = 20, anchor: int = 6) -> DataFrame:
    """doc (doc_id; null: the smallest long), text (its hash), repeats: array of packed places, for documents that have any (a table)."""
    if not 1 <= anchor <= window <= 255:
        raise ValueError("an anchor must fit into a window, and a window have 255 words at most")

    def row(a: np.ndarray, b: np.ndarray, doc: int, at: np.ndarray, key: int) -> tuple:
        return signed(a), signed(b), np.full(len(a), doc, np.int64), at, np.full(len(a), key, np.int64)

    def spans(doc: int, key: int, text: str):
        a, b, start, count = anchor_spans(WordHashes(WORD_BYTES.findall(text.encode())), window, anchor)
        # count stays under 256: an anchor is picked by window - anchor + 1 windows at most
        return row(a, b, doc, pack_at(start, count), key) if len(a) else None

    doc, key = doc_key()
    texts = docs.filter(F.col("text").isNotNull()).select(doc.alias("doc"), key.alias("key"), "text")
    seeds = map_arrow(texts, lambda batches: gathered(spans, batches), SCHEMA)
    marked = materialize(deal_and_mark(seeds, leaders=True), "substring-spans")

    def windows(doc: int, key: int, text: str, places: list[int]):
        hashes = WordHashes(WORD_BYTES.findall(text.encode()))
        at = np.concatenate([np.arange(x >> 8, (x >> 8) + (x & 255)) for x in places])
        return row(hashes.runs(at, window), hashes.runs(at, window, BASES[1]), doc, pack_at(at, 1), key)

    # sets, bounded by the document's own places however often its row is there
    leaders = marked.filter("not repeat").groupBy("doc", F.col("text").alias("key")).agg(F.collect_set("at").alias("places"))
    extended = map_arrow(texts.join(leaders, ["doc", "key"]).select("doc", "key", "text", "places"), lambda batches: gathered(windows, batches), SCHEMA)
    rest = deal_and_mark(extended, leaders=False)
    every = marked.filter("repeat").select("doc", "text", "at").unionByName(rest.select("doc", "text", "at"))
    return materialize(every.groupBy("doc", "text").agg(F.collect_set("at").alias("repeats")), "substring-repeats")


def runs_of(places: list[int] | None, window: int) -> list[tuple[int, int]]:
    """The maximal runs of words, [start, end), under the marked windows."""
    out: list[tuple[int, int]] = []
    for x in sorted(places or ()):
        start = x >> 8
        end = start + (x & 255) + window - 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _with_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs with their repeats as a last column."""
    new = free_prefix(docs.columns)
    right = repeats.select(*(F.col(c).alias(f"{new}{c}") for c in ("doc", "text", "repeats")))
    doc, key = doc_key()
    joined = docs.join(right, (doc == F.col(f"{new}doc")) & (key == F.col(f"{new}text")), "left")
    return joined.select(*(quoted(c) for c in docs.columns), F.col(f"{new}repeats"))


def kept_words(docs: DataFrame, window: int = 20, anchor: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, runs (array of start, end in words), kept (the words left, space-joined), a row for
    each row of docs.

    A word goes if a window over it has the same words as a window that starts earlier: in a document of smaller doc_id
    or further ahead in its own. Null, empty and shorter texts lose nothing. A null doc_id is before all others. Rows
    that are there twice are one document, none of them loses words to the other; rows of one doc_id (or of none) with
    different texts, told apart by 64 bits of them, are documents side by side, ranked by place, then by that hash.
    Empty tables give an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for text, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = (text or "").encode()
                    words = WORD_BYTES.findall(data)
                    runs = runs_of(places, window)
                    kept, at = [], 0
                    for start, end in runs:
                        kept += words[at:start]
                        at = end
                    kept += words[at:]
                    rows.append((len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in runs], b" ".join(kept).decode()))
                kinds = (pa.int64(), pa.int64(), kind, pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_removed", "runs", "kept"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = _with_repeats(narrow, find_repeats(narrow, window, anchor))
    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, runs array<struct<start: long, end: long>>, kept string")


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the runs of words; what stands between the words that stay is kept, a cut leaves the white space before it."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in runs:
        out.append(text[at : words[start][0]])
        at = words[end][0] if end < len(words) else words[-1][1]
    return ("".join(out) + text[at:]).rstrip() if runs and runs[-1][1] >= len(words) else "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = 6) -> DataFrame:
    """docs with the repeats cut out of text (and n_chars, if there, counted anew); a document that loses all its words goes.

    Null ids, repeated rows and null, empty and short texts are as in kept_words; an empty table gives an empty one. Other
    columns stay, whatever their names.
    """
    at, length_at, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts, keep = part.column(at).to_pylist(), [True] * part.num_rows
                lengths = part.column(length_at).to_pylist() if length_at is not None else None
                for i, places in enumerate(part.column(n).to_pylist()):
                    runs = runs_of(places, window)
                    if runs:
                        texts[i] = cut(texts[i], runs)
                        keep[i] = bool(WORD.search(texts[i]))
                        if lengths:
                            lengths[i] = len(texts[i])
                columns = list(part.columns[:n])
                columns[at] = pa.array(texts, part.column(at).type)
                if lengths is not None:
                    columns[length_at] = pa.array(lengths, part.column(length_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(part.schema)[:n])).filter(pa.array(keep, pa.bool_()))

    return map_columns(_with_repeats(docs, find_repeats(docs, window, anchor)), run, n)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 over the whole of documents."""
    found = kept_words(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS content
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS n FROM v) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM later, (SELECT unnest(generate_series(0, 19)) AS j)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
