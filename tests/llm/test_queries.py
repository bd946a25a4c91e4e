"""The registered queries themselves, over small tables with odd rows, and what they leave behind."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pathloom.llm import chat, quality, queries, simhash, store, substring, topk

from .test_chat_topk import brute_top, conversations, embeddings
from .test_dedup import brute_components, brute_fingerprint, brute_repeats


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(embeddings(200), "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_op1(spark, folder, corpus):
    prints = {i: brute_fingerprint(t, 3) for i, t in corpus}
    roots = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash(spark, folder).collect()} == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_op3(spark, folder, corpus):
    got = {r["doc_id"]: r for r in quality.op3_quality(spark, folder).collect()}
    for i, t in corpus:
        stats = quality.rule_stats(t)
        assert tuple(got[i][c] for c in quality.STATS) == stats
        assert got[i]["base_failed"] == bool(quality.base_fails(stats[0], stats[4])) and not (got[i]["kept"] and got[i]["base_failed"])


def test_op6(spark, folder, corpus):
    expected = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in brute_repeats(corpus, 20).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op6_substring(spark, folder).collect()} == expected


def test_op9_and_op10(spark, folder):
    assert chat.op9_chat(spark, folder).count() == len(conversations())
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op10_topk(spark, folder).collect()}
    assert got == brute_top([(i, v) for i, v in embeddings(200)], 5)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, folder, tmp_path, name):
    for table in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).collect() == []


def test_scratch_keeps_what_it_is_told(spark):
    with store.scratch(spark) as keep:
        a, b = (store.materialize(spark.range(n), "test") for n in (3, 4))
        keep.append(b)
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound"):
        spark.read.parquet(a._pathloom_path).count()
