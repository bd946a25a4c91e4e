"""The pipeline against a brute-force version of its fixed stages, and its entry points."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pathloom.llm import queries
from pathloom.llm.quality import base_fails, rule_stats
from pathloom.llm.secrets import redact

from .test_dedup import WORD, brute_components, brute_repeats, jaccard, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick, rows = random.Random(11), []
    vocabulary = ["".join(pick.choice("aeiounrstl") for _ in range(pick.randint(2, 8))) for _ in range(3000)]
    make = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    shared = make(70)
    for i in range(220):
        words = make(pick.randint(60, 250))
        if i % 10 == 0:
            words = [w + pick.choice(["###", "$$$", "%%%", ""]) for w in words]
        if i % 9 == 1:
            words[20:20] = shared
        if i % 15 == 2:
            words.insert(5, "password=hunter2hunter2")
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[3 * i + 1][1]) for i in range(12)]  # copies
    rows += [(400 + i, rows[4 * i + 3][1] + " ") for i in range(5)]
    rows += [(450 + i, rows[5 * i + 3][1] + " one more end") for i in range(5)]
    rows += [(500, None), (501, ""), (502, "short one"), (503, "word " * 300)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    base = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(i, 0 if i % 10 == 0 else 1, 0) for i in range(0, 220, 2)] + [(i, 1, 0) for i in range(1, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    one = stage["quality"](spark, docs, folder)
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == docs.columns and len(kept) == one.count()
    stats = {i: rule_stats(t) for i, t in texts.items()}
    passing = {i for i, s in stats.items() if not base_fails(s[0], s[4])}
    assert set(kept) <= passing
    wrong = [i for i in passing if (i in kept) != (stats[i][2] == 0)]
    assert len(wrong) <= 0.03 * len(passing)

    two = stage["near_dedup"](spark, one, folder)
    sets = {i: shingles(t) for i, t in kept.items()}
    roots = brute_components(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    left = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == docs.columns and left == {i: t for i, t in kept.items() if roots[i] == i}
    assert len(left) < len(kept)

    three = stage["substring_dedup"](spark, two, folder)
    expected = brute_repeats(list(left.items()), 20)
    found = {r["doc_id"]: r["text"] for r in three.collect()}
    assert three.columns == docs.columns
    assert {i: " ".join(WORD.findall(t)) for i, t in found.items()} == {i: e[2] for i, e in expected.items() if e[2]}
    assert any(e[1] for e in expected.values())

    four = stage["secrets"](spark, three, folder)
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in four.collect()}
    assert four.columns == docs.columns and {i: t for i, (t, _) in clean.items()} == {i: redact(t) for i, t in found.items()}
    assert any("[SECRET]" in t for t, _ in clean.values()) and all(n == len(t) for t, n in clean.values())

    five = stage["packing"](spark, four, folder)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == set(clean)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(five.columns)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_nulls_repeats_and_clashes(spark, folder):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({"component_id": F.lit(1), "fp": F.lit("x"), "doc": F.lit(3), "length": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.collect()
    kept = corpus_pipeline.near_dedup(spark, docs.filter("doc_id = 1"), folder)
    assert kept.count() == 1
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_column_names_that_stages_use_themselves(spark, folder):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (3, "Before that: " + text, "en", "s", 1), (4, "other " * 30, "en", "s", 1)]
    names = ["doc", "text_", "repeats", "doc_id_", "h1", "h2", "row", "kept_doc_id", "a.b", "x`y"]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({f"{p}{c}": F.lit(i) for i, c in enumerate(names) for p in ("", "__", "___")}).withColumn("__DOC_ID", F.lit(7))
    kept = corpus_pipeline.near_dedup(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]
    cut = corpus_pipeline.substring_dedup(spark, docs, folder)
    got = {r["doc_id"]: r for r in cut.collect()}
    for stage in (corpus_pipeline.quality, corpus_pipeline.secrets):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and len(out.collect()) <= docs.count()
    assert cut.columns == docs.columns and got[3]["text"].split() == ["Before", "that:"] and {r["__text_"] for r in got.values()} == {1}


def test_which_of_equal_rows_stays(spark):
    """The one whose other columns come first, however the rows are dealt."""
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(5, text, None if i == 39 else "en", f"src{i:02}", i) for i in range(40)], COLUMNS)
    for n in (1, 3, 5, 8):
        assert [r["source"] for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()] == ["src00"]


def test_near_dedup_decides_by_text(spark):
    """Unlike texts of one doc_id, or of none, stay; copies among them go."""
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(80)) for c in "abcd")
    rows = [(1, one), (5, one + " more"), (5, two), (5, two), (6, two + " more"), (None, one), (None, three), (None, three), (None, three + " more"), (None, four), (9, four)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS).repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert got[0] in [(0, three), (0, three + " more")] and got[1:] == [(1, one), (5, two), (9, four)]


def test_entry_points():
    found = __spark_entry__.queries()
    assert found["pipeline"] and {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.queries()) <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
