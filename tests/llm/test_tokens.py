"""Operators 2, 4, 5 and 8 against the tokenizers library and plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm import bpe, bytebpe, packing, tokencount, tokenfiles
from pathloom.llm.store import materialize, new_path

WORD, BYTE = bpe.default_path("word_bpe_49k.json"), bpe.default_path("byte_bpe_50k.json")
ODD = ["<|endoftext|>a <|startoftext|><|endoftext|>", "aaaa" * 3000, "don't we'll 'S", "é Å ﬁ ΑΣ ΑΣ. İ", "\x85a\xa0b c　", "1²½ Ⅷ", "a\x1cb"]


def library(path):
    return Tokenizer.from_file(path)


def test_backtracking_equals_library():
    own, other, pick = bpe.WordBpe(WORD), library(WORD), random.Random(3)
    texts = ODD + ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz" * 3 + "ABC 'éß12.,$%&\n\t日本Σσİ") for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    texts += [f"A{chr(c)}a 1{chr(c)}1 {chr(c)}{chr(c)}." for c in [*range(0x600), *range(0x600, 0xD800, 7), *range(0xE000, 0x110000, 331)]]
    for text in texts:
        ids = other.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text[:40]
        assert own.decode(got).decode() == other.decode(ids, skip_special_tokens=False)


def test_word_cache_is_bounded():
    own = bpe.WordBpe(WORD, words_kept=3)
    for w in "one two three four five six".split():
        assert np.frombuffer(own.encode(w), "<u4").tolist() == library(WORD).encode(w).ids
        assert len(own.word_ids) <= 3


def test_encoder_refuses_ambiguous_vocabulary():
    with pytest.raises(ValueError):
        bpe.BacktrackingEncoder({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, [(0, 1), (1, 2), (3, 2), (0, 4)])


def test_op2_over_frame(spark, docs, none, corpus):
    other = library(WORD)
    got = {r["doc_id"]: r for r in bpe.decode_documents(bpe.encode_documents(docs, WORD), WORD).collect()}
    for i, text in corpus:
        ids = other.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert got[i]["decoded"] == other.decode(ids, skip_special_tokens=False)
    assert bpe.decode_documents(bpe.encode_documents(none, WORD), WORD).count() == 0


def test_byte_bpe_equals_library():
    own, other, plain = bytebpe.ByteBpe(BYTE), library(BYTE), library(BYTE)
    plain.encode_special_tokens = True
    texts = ODD + ["a\n\n  b" + "\t" * 1000, " " * 3_000_000] + [f"a{chr(c)}a 1{chr(c)}1 {chr(c)}." for c in [*range(0x600), *range(0x600, 0x3000, 5), *range(0xE000, 0x110000, 331)]]
    for text in texts:
        assert own.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids
        assert own.encode(text, special=False).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert own.encode(None).tolist() == []


def check_places(rows, most):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return len(used)


def test_op4_over_frame(spark, docs, none, corpus):
    other = library(BYTE)
    rows = packing.pack_documents(docs, BYTE, most=256).collect()
    by_doc = defaultdict(dict)
    for r in rows:
        by_doc[r["doc_id"]][r["piece"]] = r
    assert set(by_doc) == {i for i, _ in corpus}
    total = 0
    for i, text in corpus:
        ids = [*other.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 256 or 256
        edges = [0, *range(first, len(ids), 256), len(ids)]
        assert sorted(by_doc[i]) == list(range(len(edges) - 1))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            r = by_doc[i][k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert check_places(rows, 256) <= 1.05 * total / 256 + 1
    assert packing.pack_documents(none, BYTE).count() == 0


def test_pack_hot_length_and_ties(spark):
    rows = [(i % 5, 700) for i in range(3000)] + [(i, 648) for i in range(1500)]
    table = materialize(spark.createDataFrame(rows, "n long, length long"), "test")
    got = packing.pack(table).collect()
    assert len(got) == len(rows) and check_places(got, 2048) == 1500
    counts = {700: 3000, 648: 1500}
    ranks = packing.rank_within_length(table, counts, rows_per_part=100).collect()
    for length, n in counts.items():
        assert sorted(r["_rank"] for r in ranks if r["length"] == length) == list(range(n))


def test_best_two_fit_swaps_the_smallest():
    # 6 leaves a gap of 4: 3 fits greedily, but 2 + 2 fit better
    assert sorted(best_of({6: 1, 3: 1, 2: 2}, 10)) == [[3], [6, 2, 2]]
    pick = random.Random(1)
    for _ in range(30):
        counts = Counter(pick.randint(1, 40) for _ in range(pick.randint(1, 200)))
        plan = packing.best_two_fit(counts, 40)
        packed = Counter()
        for filling, times in plan:
            assert sum(filling) <= 40
            for x in filling:
                packed[x] += times
        assert packed == counts
    with pytest.raises(ValueError):
        packing.best_two_fit({50: 1}, 40)


def best_of(counts, most):
    return [sorted(f, reverse=True) for f, n in packing.best_two_fit(counts, most) for _ in range(n)]


def test_op5_files(spark, docs, none, corpus):
    other, folder = library(BYTE), new_path(spark, "test-files")
    dictionary = tokenfiles.train_dictionary(docs, BYTE)
    assert dictionary
    files = tokenfiles.write_token_files(docs, BYTE, folder, dictionary, file_bytes=4000)
    assert files.count() > 3
    got = {r["doc_id"]: r for r in tokenfiles.read_token_files(files, dictionary).collect()}
    start = 0
    for i, text in sorted(corpus):
        ids = [*other.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        start += len(ids)
    one = tokenfiles.TokenFile(files.orderBy("file_no").first()["path"], dictionary)
    k = len(one.counts) - 1
    assert one.ids(k).tolist() == np.frombuffer(got[int(one.doc_ids[k])]["ids"], "<u4").tolist()
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(files.first()["path"], dictionary + b"x")
    empty = tokenfiles.write_token_files(none, BYTE, new_path(spark, "test-none"), tokenfiles.train_dictionary(none, BYTE))
    assert tokenfiles.read_token_files(empty, b"").count() == 0


def test_op5_dictionary_of_any_table(spark, docs):
    """One doc_id for all rows, none at all, or the same row over and over leave a sample."""
    for doc_id in (5, 6, 9, None):
        one = docs.withColumn("doc_id", F.lit(doc_id).cast("long"))
        assert len(tokenfiles.train_dictionary(one, BYTE, sample_docs=20)) > 500
        assert tokenfiles.distinct_sample(one, 20, 100).count() == 20
    same = spark.range(300).select(F.lit(5).alias("doc_id"), F.lit("the same words").alias("text"))
    assert tokenfiles.distinct_sample(same, 20, 100).count() == 1 and tokenfiles.train_dictionary(same, BYTE, sample_docs=20)


def test_op5_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (1, None)], "doc_id long, text string")
    files = tokenfiles.write_token_files(docs, BYTE, new_path(spark, "test-files"), b"")
    rows = sorted(tokenfiles.read_token_files(files, b"").collect(), key=lambda r: r["start"])
    assert (rows[0]["doc_id"], rows[0]["n_tokens"]) == (None, 3) and sorted((r["doc_id"], r["n_tokens"]) for r in rows[1:]) == [(1, 1), (1, 2), (1, 2)]
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]


def test_op5_one_id_is_spread_over_files(spark):
    docs = spark.createDataFrame([(7 if i % 2 else None, f"text {i % 40}") for i in range(3000)], "doc_id long, text string").repartition(4)
    files = tokenfiles.write_token_files(docs, BYTE, new_path(spark, "test-files"), b"", file_bytes=2000)
    sizes = [r["n_docs"] for r in files.collect()]
    assert sum(sizes) == 3000 and len(sizes) > 8 and max(sizes) < 600
    for stretch in (3, 4096):
        rows = sorted(tokenfiles.read_token_files(files, b"", stretch).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in rows] == [None] * 1500 + [7] * 1500
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]


def test_op4_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 2000 + [(None, "x")] * 10 + [(None, None)], "doc_id long, text string").withColumns({"length": F.lit(1), "_rank": F.lit(2)}).repartition(3)
    rows = packing.pack_documents(docs, BYTE).collect()
    assert len(rows) == 2011 and check_places(rows, 2048) == -(-sum(r["length"] for r in rows) // 2048)


def test_op8_and_op2_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a b"), (None, None), (2, "w " * 30_000)], "doc_id long, text string").withColumns({"ids": F.lit(1), "path": F.lit("x"), "n": F.lit(2)})
    order = tokencount.write_flat_files(docs, BYTE, new_path(spark, "test-flat"), 50256)
    files = materialize(tokencount.file_sizes(order.select("path").distinct()), "test")
    counts = order.join(tokencount.count_tokens(files, 50256), ["path", "ordinal"]).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in counts), key=str) == sorted([(1, 3)] * 3 + [(None, 2), (None, 0), (2, 30_001)], key=str)
    assert tokencount.id_width(BYTE, 50256) == 2 and tokencount.id_width(BYTE, 1 << 16) == 4
    both = bpe.decode_documents(bpe.encode_documents(docs, WORD), WORD)
    assert sorted((str(r["doc_id"]), len(r["ids"]) // 4, len(r["decoded"].split())) for r in both.collect()) == sorted([("1", 3, 3)] * 3 + [("None", 2, 2), ("None", 0, 0), ("2", 30_000, 30_000)])
    assert bpe.encode_documents(docs.limit(0), WORD).count() == bpe.decode_documents(docs.limit(0).withColumn("ids", F.lit(b"")), WORD).count() == 0


def test_op4_and_op8_queries(spark, tmp_path):
    rows = [(i, f"text {i} " * (i * 40)) for i in range(12)] + [(20, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    byte = library(BYTE)
    four, eight = packing.op4_packing(spark, str(tmp_path)).collect(), tokencount.op8_token_counts(spark, str(tmp_path)).collect()
    check_places(four, 2048)
    for i, t in rows:
        ids = byte.encode(t or "", add_special_tokens=False).ids
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in four if r["doc_id"] == i)
        assert sum(p[2] for p in pieces) == len(ids) + 1
        for _, start, length, crc in pieces:
            assert crc == zlib.crc32(np.array([*ids, 0][start : start + length], "<u4").tobytes())
        assert [r["n_tokens"] for r in eight if r["doc_id"] == i] == [len(ids)]


def test_op8_counts(spark, docs, none, corpus):
    other = library(BYTE)
    other.encode_special_tokens = True
    order = tokencount.write_flat_files(docs, BYTE, new_path(spark, "test-flat"), 50256)
    files = materialize(tokencount.file_sizes(order.select("path").distinct()), "test")
    got = order.join(tokencount.count_tokens(files, 50256, block_bytes=1000), ["path", "ordinal"]).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in corpus}
    assert len(got) == len(corpus)
    assert tokencount.write_flat_files(none, BYTE, new_path(spark, "test-flat"), 50256).count() == 0


def test_op8_stitching(spark, tmp_path):
    pick, rows, expected = random.Random(2), [], []
    for f in range(6):
        ids = [pick.choice([9, 9, 1, 2, 3]) if f % 2 else pick.choice([9] + [1] * 40) for _ in range(pick.randint(0, 300))]
        path = tmp_path / f"{f}.bin"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        rows.append((str(path), len(ids) * 2))
        start = n = 0
        for i, x in enumerate(ids):
            if x == 9:
                expected.append((str(path), n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            expected.append((str(path), n, start, len(ids) - start, False))
    files = materialize(spark.createDataFrame(rows, "path string, bytes long"), "test")
    for block in (2, 7, 64, 4096):
        got = [tuple(r) for r in tokencount.count_tokens(files, 9, block_bytes=block).select("path", "ordinal", "start", "n_tokens", "ended").collect()]
        assert sorted(got) == sorted(expected)


def test_digests(spark, tmp_path):
    rows = [(3, "Hello <|endoftext|> World"), (1, None), (2, "x" * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    word, byte = library(WORD), library(BYTE)
    two = {r["doc_id"]: r for r in bpe.op2_bpe(spark, str(tmp_path)).collect()}
    five = {r["doc_id"]: r for r in tokenfiles.op5_token_files(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = word.encode(t or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert tuple(two[i]) == (i, len(ids), digest, text)
        ids = [*byte.encode(t or "", add_special_tokens=False).ids, 2]
        assert (five[i]["n_tokens"], five[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
