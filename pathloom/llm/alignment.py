"""Alignment of two tokenizers: groups of tokens that end together, links, and how often ids are linked in the whole corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bpe import default_path
from pathloom.llm.bytebpe import byte_bpe
from pathloom.llm.store import map_arrow, materialize, read_table, slices

#: Stripes of side ids; a stripe's dense block has V_B / STRIPES rows of V_A counts, some 100 MB for the public vocabularies.
STRIPES = 128
#: A worker forgets its segments when it has so many.
MOST_SEGMENTS = 300_000
#: Of text, and of texts, in a slice; places in it have 16 bits.
SLICE_BYTES, MOST_TEXTS = 4 << 20, 1 << 15
NO_TOKENS = (0, 0, 0, 0, "")


def segments_of(text: str) -> list[str]:
    """space+text cut ahead of each space that follows something else than white space; the segments without their first space.

    No token of either vocabulary passes such a place: one splits words ahead of a space before it merges, the other has no
    piece with a space behind another character. So segments can be encoded one by one.
    """
    parts, out, hold = text.split(" "), [], None
    for part in parts:
        if hold is not None:
            part = f"{hold} {part}"
        if part and not part[-1].isspace():
            out.append(part)
            hold = None
        else:
            hold = part
    if hold is not None:
        out.append(hold)
    return out


class Segments(dict):
    """segment -> its number, for segments that both vocabularies have encoded; what they give stands in arrays by number."""

    def __init__(self, byte_path: str, piece_path: str, stripes: int):
        import sentencepiece

        super().__init__()
        self.bytes_bpe = byte_bpe(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece has a space behind another character")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        encoding = self.bytes_bpe.encoding
        self.a_bytes = [b""] * self.bytes_bpe.size
        for token in encoding.token_byte_values():
            self.a_bytes[encoding.encode_single_token(token)] = token
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.width, self.stripes, self.rows = self.bytes_bpe.size, stripes, -(-len(names) // stripes)
        ids = range(max(self.width, len(names)))
        self.ids, self.names = len(ids), [f"{i}{mark}".encode() for mark in ",|;" for i in ids]
        self.name_size = np.array([len(x) for x in self.names], np.int64)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.strings: list[bytes] = []
        self.unlike: set[int] = set()  # segments whose tokens' bytes are not theirs
        self.sizes = np.empty((0, 3), np.int64)  # tokens of either side, groups
        self.links, self.codes = np.zeros(1, np.int64), np.empty(0, np.int64)  # where a segment's links begin; the links' codes

    def add(self, segments: list[str]) -> None:
        """Encodes new segments, many in one call: behind each other they are cut as each is by itself, if none ends in white space."""
        for part in range(0, len(segments), 4096):
            many, alone = [], []
            for x in segments[part : part + 4096]:
                (many if x and len(x) < 4096 and not x[-1].isspace() else alone).append(x)
            if many and not self._encode(many):
                alone = many + alone
            for x in alone:
                if not self._encode([x]):
                    self._append([x], [b""], np.zeros((1, 3), np.int64), np.zeros(1, np.int64), np.empty(0, np.int64))
                    self.unlike.add(self[x])

    def _append(self, segments: list[str], strings: list[bytes], sizes: np.ndarray, links: np.ndarray, codes: np.ndarray) -> None:
        self.update(zip(segments, range(len(self.strings), len(self.strings) + len(segments)), strict=True))
        self.strings += strings
        self.sizes = np.concatenate((self.sizes, sizes))
        self.links, self.codes = np.concatenate((self.links, self.links[-1] + np.cumsum(links))), np.concatenate((self.codes, codes))

    def _encode(self, segments: list[str]) -> bool:
        """False, and nothing is kept, if the tokens' bytes are not the segments' or a token passes the end of a segment."""
        full = "".join([f" {x}" for x in segments])
        data = full.encode("utf-8", "replace")
        a = self.bytes_bpe.encode(full, special=False).astype(np.int64)
        b = np.array(self.pieces.encode(full[1:]) if len(full) > 1 else [self.pieces.piece_to_id("▁")], np.int64)  # a space at a text's end
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != data or b"".join([self.b_bytes[i] for i in b.tolist()]) != data:
            return False
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        marks = np.zeros(len(data) + 1, np.int8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        cuts = np.flatnonzero(marks)  # between two cuts there is one token of either side: a link
        kind = marks[cuts]
        is_a, is_b, is_group = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64), (kind == 3).astype(np.int64)
        at_a, at_b, group = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, np.cumsum(is_group) - is_group
        stops = np.cumsum([len(x.encode("utf-8", "replace")) + 1 for x in segments])
        if (marks[stops] != 3).any():
            return False
        last = np.searchsorted(cuts, stops)  # the last cut of each segment
        counts = np.diff(np.stack([at_a[last] + 1, at_b[last] + 1, group[last] + 1, last + 1], axis=1), axis=0, prepend=0)
        side = b[at_b]
        codes = ((side % self.stripes) * self.rows + side // self.stripes) * self.width + a[at_a]
        # names in order of groups, A's ahead of B's; a name ends in the mark behind it
        group_a, group_b = group[is_a == 1], group[is_b == 1]
        until = np.concatenate(([0], np.flatnonzero(is_group) + 1))
        sum_a, sum_b = (np.concatenate(([0], np.cumsum(x)))[until] for x in (is_a, is_b))  # tokens ahead of each group
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + sum_b[group_a]] = a + self.ids * (kind[is_a == 1] == 3)
        order[np.arange(len(b)) + sum_a[group_b + 1]] = b + 2 * self.ids * (kind[is_b == 1] == 3)
        text = b"".join(map(self.names.__getitem__, order.tolist()))
        stop = np.cumsum(self.name_size[order])[np.cumsum(counts[:, 0] + counts[:, 1]) - 1].tolist()
        strings = [text[i : j - 1] for i, j in zip([0, *stop], stop, strict=False)]
        self._append(segments, strings, counts[:, :3], counts[:, 3], codes)
        return True


@lru_cache(1)
def worker_segments(byte_path: str, piece_path: str, stripes: int) -> Segments:
    """One for each Python worker."""
    return Segments(byte_path, piece_path, stripes)


def counted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order and the sums of their weights."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate((values[:1] == values[:1], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def align_texts(known: Segments, texts: list[str | None], with_groups: bool) -> tuple[list[tuple], list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """For each text (n_a, n_b, n_groups, n_links, groups_sha256), and its groups if asked for; then links as the code of
    their pair, the place of the text and their number there, by code, then place."""
    if len(known) > MOST_SEGMENTS:
        known.forget()
    rows, groups, numbers, places = [NO_TOKENS] * len(texts), [None] * len(texts), [], []
    parts = [segments_of(text) if text else None for text in texts]
    known.add(list(set().union(*filter(None, parts)).difference(known)))
    for place, part in enumerate(parts):
        if part:
            own = list(map(known.__getitem__, part))
            if known.unlike.isdisjoint(own):
                joined = b";".join(map(known.strings.__getitem__, own))
                numbers.append(np.array(own, np.int64))
                places.append(place)
                rows[place] = hashlib.sha256(joined).hexdigest()
                groups[place] = joined.decode() if with_groups else None
    none = np.empty(0, np.int64)
    if not places:
        return rows, groups, none, none, none
    keys, times = np.unique(np.concatenate([(np.int64(p) << 32) | n for p, n in zip(places, numbers, strict=True)]), return_counts=True)
    place, number = keys >> 32, keys & 0xFFFFFFFF
    sums = np.add.reduceat(known.sizes[number] * times[:, None], np.searchsorted(place, places))
    for p, (n_a, n_b, n_groups) in zip(places, sums.tolist(), strict=True):
        rows[p] = (n_a, n_b, n_groups, n_a + n_b - n_groups, rows[p])  # in a group of p and q tokens there are p + q - 1 links
    many = known.links[number + 1] - known.links[number]
    at = np.arange(many.sum()) + np.repeat(known.links[number] - np.cumsum(many) + many, many)
    pairs, n = counted((known.codes[at] << 16) | np.repeat(place, many), np.repeat(times, many))
    return rows, groups, pairs >> 16, pairs & 0xFFFF, n


ENCODED = "slice long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, stripe int, codes binary, sizes binary, places binary, n binary"


def encoded(docs: DataFrame, byte_path: str, piece_path: str, stripes: int, with_groups: bool) -> DataFrame:
    """A table of two kinds of rows, from one pass over whole texts without a shuffle: one for each row of docs, and one for
    each slice of texts and stripe that its links have, in which arrays stand as binaries (codes of pairs within the stripe,
    how many texts each has, places of these texts in the slice, links there)."""
    names = [f.split()[0] for f in ENCODED.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in ENCODED.split(", ")]

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = worker_segments(byte_path, piece_path, stripes), TaskContext.get().partitionId() << 32
        block = known.rows * known.width
        for batch in batches:
            for part in (cut.slice(i, MOST_TEXTS) for cut in slices(batch, 1, SLICE_BYTES) for i in range(0, cut.num_rows, MOST_TEXTS)):
                n = part.num_rows
                found, groups, codes, places, times = align_texts(known, part.column(1).to_pylist(), with_groups)
                yield rows({"slice": [number] * n, "place": range(n), "doc_id": part.column(0).to_pylist(), "groups": groups} | dict(zip(names[3:8], zip(*found, strict=True), strict=True)), n)
                edges = np.searchsorted(codes, np.arange(stripes + 1) * block)
                chunks = {c: [] for c in ("stripe", "codes", "sizes", "places", "n")}
                for stripe in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[stripe], edges[stripe + 1])
                    pairs, sizes = np.unique(codes[own] - stripe * block, return_counts=True)
                    for name, value in zip(chunks, (stripe, *(x.tobytes() for x in (pairs.astype("<u4"), sizes.astype("<u2"), places[own].astype("<u2"), times[own].astype("<u4")))), strict=True):
                        chunks[name].append(value)
                yield rows(chunks | {"slice": [number] * len(chunks["stripe"])}, len(chunks["stripe"]))
                number += 1

    return materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, ENCODED), "aligned")


def array_of(batch: pa.RecordBatch, column: int, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def link_sums(links: DataFrame, block: int) -> DataFrame:
    """stripe, salt, codes, n: the links of each pair, summed within a batch ahead of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sums = [], []
            for row in range(batch.num_rows):
                sizes = array_of(batch, 3, row, "<u2").astype(np.int64)
                n = np.add.reduceat(array_of(batch, 4, row, "<u4").astype(np.int64), np.cumsum(sizes) - sizes)
                stripe, salt = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                keys.append((np.int64(salt * 65536 + stripe) * block) + array_of(batch, 2, row, "<u4"))
                sums.append(n)
            if keys:
                yield from packed(*counted(np.concatenate(keys), np.concatenate(sums)), block)

    return map_arrow(links.select("stripe", "salt", "codes", "sizes", "n"), run, "stripe int, salt int, codes binary, n binary")


def packed(keys: np.ndarray, n: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    groups = keys // block
    edges = [*np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))).tolist(), len(keys)]
    for a, b in zip(edges, edges[1:], strict=False):
        key = int(groups[a])
        yield from count_rows(key % 65536, key // 65536, (keys[a:b] - key * block).astype("<u4"), n[a:b])


def count_rows(stripe: int, salt: int, codes: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(codes), most):
        columns = [pa.array([stripe], pa.int32()), pa.array([salt], pa.int32()), pa.array([codes[i : i + most].tobytes()], pa.binary()), pa.array([n[i : i + most].astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["stripe", "salt", "codes", "n"])


def block_sums(rows: DataFrame, block: int, *keys: str) -> DataFrame:
    """The counts of each key added up in a dense block; a task has one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                key = tuple(batch.column(i)[row].as_py() for i in range(2))
                if key != now:
                    if now is not None:
                        yield from filled(now, counts)
                    now, counts = key, np.zeros(block, np.int64)
                np.add.at(counts, array_of(batch, 2, row, "<u4"), array_of(batch, 3, row, "<i8"))
        if now is not None:
            yield from filled(now, counts)

    def filled(key: tuple[int, int], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = np.flatnonzero(counts)
        yield from count_rows(*key, codes.astype("<u4"), counts[codes])

    rows = rows if "salt" in keys else rows.withColumn("salt", F.lit(0))
    return map_arrow(rows.select("stripe", "salt", "codes", "n").repartition(*keys).sortWithinPartitions("stripe", "salt"), run, "stripe int, salt int, codes binary, n binary")


def scored(links: DataFrame, counts: DataFrame, rows: int, width: int, most_places: int = 500_000) -> DataFrame:
    """slice, places, best, total: for texts of a slice the links whose pair is its side id's most frequent, and the sum of
    the counts over links. The counts of a stripe come ahead of its links, whose chunks then pass one by one."""

    def flushed(sums: dict) -> Iterator[pa.RecordBatch]:
        for number, (best, total) in sums.items():
            places = np.flatnonzero(total)
            columns = [pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (places.astype("<u2"), best[places].astype("<i8"), total[places].astype("<i8")))]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "places", "best", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, highest, sums, held = None, None, None, {}, 0
        for batch in batches:
            for row in range(batch.num_rows):
                key = tuple(batch.column(i)[row].as_py() for i in range(2))
                if key != now:
                    now, block, highest = key, np.zeros(rows * width, np.int64), None
                codes = array_of(batch, 4, row, "<u4")
                if not batch.column(2)[row].as_py():
                    block[codes] = array_of(batch, 7, row, "<i8")
                    continue
                if highest is None:
                    highest = block.reshape(rows, width).max(axis=1)
                number, sizes, places = batch.column(3)[row].as_py(), array_of(batch, 5, row, "<u2"), array_of(batch, 6, row, "<u2")
                n, count = array_of(batch, 7, row, "<u4").astype(np.int64), block[codes]
                if number not in sums:
                    sums[number] = (np.zeros(1 << 16, np.int64)[:0], np.zeros(0, np.int64))
                best, total = sums[number]
                if len(total) <= (top := int(places.max())):
                    best, total = (np.concatenate((x, np.zeros(top + 1 - len(x), np.int64))) for x in (best, total))
                    held += top + 1 - len(sums[number][0])
                    sums[number] = (best, total)
                np.add.at(total, places, np.repeat(count, sizes) * n)
                np.add.at(best, places, np.repeat(count == highest[codes // width], sizes) * n)
                if held > most_places:
                    yield from flushed(sums)
                    sums, held = {}, 0
        yield from flushed(sums)

    salts = links.select("stripe", "salt").distinct()
    first = counts.drop("salt").join(salts, "stripe").select("stripe", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("slice"), "codes", F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast("binary").alias("places"), "n")
    then = links.select("stripe", "salt", F.lit(1).alias("kind"), "slice", "codes", "sizes", "places", "n")
    both = first.unionByName(then).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    return map_arrow(both, run, "slice long, places binary, best binary, total binary")


def by_place(scores: DataFrame) -> DataFrame:
    """slice, place, n_best, count_sum from the partial sums of all stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, None, None

        def rows() -> pa.RecordBatch:
            places = np.flatnonzero(total)
            columns = [pa.array([now] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array(best[places], pa.int64()), pa.array(total[places], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["slice", "place", "n_best", "count_sum"])

        for batch in batches:
            for row in range(batch.num_rows):
                number, places = batch.column(0)[row].as_py(), array_of(batch, 1, row, "<u2")
                if number != now:
                    if now is not None:
                        yield rows()
                    now, best, total = number, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
                np.add.at(best, places, array_of(batch, 2, row, "<i8"))
                np.add.at(total, places, array_of(batch, 3, row, "<i8"))
        if now is not None:
            yield rows()

    return map_arrow(scores.repartition("slice").sortWithinPartitions("slice"), run, "slice long, place int, n_best long, count_sum long")


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, stripes: int = STRIPES, with_groups: bool = False, salt_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): how a byte-level BPE (A) and a sentencepiece vocabulary (B) cut each space+text, and pair counts.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, as `a1,a2|b1;a3|b2,b3`, if
    asked for) for every row of docs. Tokens that end at the same byte end a group; tokens whose bytes overlap are linked.
    A text that is null or empty, or whose tokens' bytes are not space+text (it has U+2581, say), has no tokens: zeros and
    ''. Rows without doc_id and repeated rows each keep their row; other columns are ignored; an empty table gives empty
    frames. pairs: a_id, b_id, n_links, best (whether no other a_id is linked more often with b_id), over all rows.

    Texts are read once. Links, as counts of pairs in a text, are kept by stripes of B's ids (id modulo `stripes`). A stripe's
    counts are added up in a dense block, first by salts of the stripe, then whole, and meet its links again salt by salt;
    a stripe has as many salts as its links need, so a frequent id is no single task. Memory has one block and one chunk.
    """
    known = encoded(docs, byte_path, piece_path, stripes, with_groups)
    width, rows = byte_bpe(byte_path).size, -(-piece_count(piece_path) // stripes)
    if rows * width >= 1 << 32 or stripes > 65536:
        raise ValueError("a block of a stripe must have fewer than 2^32 counts")
    links = known.filter("stripe is not null").select("stripe", "slice", "codes", "sizes", "places", "n")
    weights = links.groupBy("stripe").agg(F.sum(F.octet_length("places")).alias("w"))
    share = weights.agg(F.least(F.lit(salt_bytes), F.floor(F.sum("w") / (2 * stripes)) + 1).alias("share"))  # one row
    salts = weights.crossJoin(share).select("stripe", F.ceil(F.col("w") / F.col("share")).cast("int").alias("salts"))  # a row for each stripe
    links = links.join(F.broadcast(salts), "stripe").withColumn("salt", F.pmod(F.xxhash64("slice"), F.col("salts")).cast("int")).drop("salts")
    block = rows * width
    counts = materialize(block_sums(block_sums(link_sums(links, block), block, "stripe", "salt"), block, "stripe"), "pair-counts")
    scores = by_place(scored(links, counts, rows, width))
    own = known.filter("stripe is null").drop("stripe", "codes", "sizes", "places", "n")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if with_groups else [])]
    return own.join(scores, ["slice", "place"], "left").select(*columns), pair_table(counts, stripes, rows, width)


def piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def pair_table(counts: DataFrame, stripes: int, rows: int, width: int) -> DataFrame:
    """a_id, b_id, n_links, best from the counts of whole stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, n = array_of(batch, 2, row, "<u4").astype(np.int64), array_of(batch, 3, row, "<i8")
                columns = [codes % width, (codes // width) * stripes + batch.column(0)[row].as_py(), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a_id", "b_id", "n_links"])

    pairs = map_arrow(counts, run, "a_id long, b_id long, n_links long")
    highest = pairs.groupBy(F.col("b_id").alias("_b")).agg(F.max("n_links").alias("_most"))
    return pairs.join(highest, pairs["b_id"] == highest["_b"]).select("a_id", "b_id", "n_links", (F.col("n_links") == F.col("_most")).alias("best"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 over the whole of documents."""
    return align_documents(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))[0]
