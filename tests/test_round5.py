"""What the findings of round 5 named: inputs read once, little shuffled, and even tasks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.functions.vectors import cosine_top_k
from pathloom.llm import passes
from pathloom.operators import search, textsearch

from .test_discovery import plan, tuples


def seen_rows(spark, df):
    """df, and an accumulator of how many of its rows were made."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def plain_bm25(asked, items, k, digits):
    """Texts of words parted by spaces."""
    words = [(i, (t or "").split()) for i, t in items]
    mean = sum(len(w) for _, w in words) / max(1, len(words))
    out = []
    for q, text in asked:
        scores = {}
        for term in set((text or "").split()):
            df = sum(term in w for _, w in words)
            for i, w in words:
                if tf := w.count(term):
                    idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        best = sorted((-round(s, digits), i) for i, s in scores.items())[:k]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return out


def test_items_are_read_once_for_words_and_lengths(spark):
    pick = random.Random(3)
    text = lambda n: " ".join(pick.choice("abcdefgh") for _ in range(pick.randint(0, n)))
    rows = [(i, text(30)) for i in range(700)] + [(700, None), (701, ""), (702, "a"), (702, "a b"), (703, "q q q")]
    asked = [(1, "a b"), (2, "q"), (3, ""), (4, None), (5, "none of these"), (6, "c c c")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, text string")
    items, seen = seen_rows(spark, frame(rows, "item_id"))
    got = textsearch.bm25_top_k(frame(asked, "query_id"), items, 4, digits=6).select("query_id", "item_id", "score", "rank").collect()
    assert seen.value == len(rows)
    want = plain_bm25(asked, rows, 4, 6)
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in got) == sorted((q, i, n) for q, i, _, n in want)
    assert {(r.query_id, r.item_id): r.score for r in got} == {(q, i): pytest.approx(s, abs=2e-6) for q, i, s, _ in want}


def test_queries_are_made_once_for_words_and_vectors(spark):
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choice("abcd") for _ in range(4)), [pick.random() + 0.1, pick.random()]) for i in range(200)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, text string, vector array<double>")
    asked = [*rows[:20], (500, None, [1.0, 0.0]), (501, "a", None), (502, "", [0.0, 0.0])]
    queries, seen = seen_rows(spark, frame(asked, "query_id"))
    items = frame(rows, "item_id")
    got = textsearch.phase_one(queries, items, 3, 8, digits=6)
    assert seen.value == len(asked)
    words = textsearch.bm25_top_k(frame(asked, "query_id"), items, 8, digits=6)
    near = cosine_top_k(frame(asked, "id").select("id", "vector"), items.select(F.col("item_id").alias("id"), "vector"), 8, 6)
    assert tuples(got) == tuples(textsearch.fused([words, near], 3, 60, 6)) and {r.query_id for r in got.collect()} == {r[0] for r in asked}


def test_search_of_no_items_or_for_no_words(spark):
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id int, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "")], "query_id int, text string")
    assert tuples(textsearch.bm25_top_k(asked, items.limit(0), 3)) == []
    assert tuples(textsearch.bm25_top_k(asked.limit(0), items, 3)) == []
    assert tuples(textsearch.bm25_top_k(asked.filter("text = ''"), items, 3)) == []
    assert tuples(textsearch.bm25_top_k(asked, items.filter("text is null"), 3)) == []


def test_fuzzy_search_shuffles_no_pairs_of_queries_and_skills(spark, monkeypatch):
    """60 queries that share a word with 400 skills: what is ranked is the best of each block, the same as from all pairs. Ids are null or come twice."""
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abc") for _ in range(pick.randint(1, 6)))
    rows = [(i, f"common {word()}", [word(), None], word()) for i in range(400)] + [(None, "common", [], None), (None, "comon", None, "x"), (7, "common abc", ["abc"], "abc"), (8, None, None, None)]
    skills = spark.createDataFrame(rows, "skill_id int, preferred_label string, alternative_labels array<string>, description string")
    queries = spark.createDataFrame([(f"comxmon {word()}",) for _ in range(60)] + [("",), (None,), ("common",), ("common",), ("abc ab a",)], "query string")
    texts = search.text_rows(skills).withColumn("weight", F.when(F.col("column") == 1, 2).otherwise(1))
    want = tuples(textsearch.best_of_each(textsearch.fuzzy_hits(texts, queries), "query", "skill_id", 3))
    ranked, plain = [], search.best_of_each
    monkeypatch.setattr(search, "best_of_each", lambda df, *a: (ranked.append(df.count()), plain(df, *a))[1])
    got = search.fuzzy_search_many(skills, queries, 3)
    assert tuples(got) == want and any(r[1] is None for r in want)
    asked = len({r[0] for r in want})
    assert ranked[0] <= asked * 3 * 4  # blocks: 4 at most, as there are shuffle partitions


def test_fuzzy_search_of_names_that_share_no_words_is_not_dealt_to_blocks(spark, monkeypatch):
    """Each query meets its own skill only: rows dealt to all blocks would be more than the pairs."""
    pick = random.Random(6)
    names = ["".join(pick.choice("abcdefghijkl") for _ in range(14)) for _ in range(150)]
    skills = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(names)], "skill_id int, preferred_label string, alternative_labels array<string>, description string")
    queries = skills.select(F.concat(F.lit("x"), "preferred_label").alias("query"))
    monkeypatch.setattr(textsearch, "best_in_blocks", None)
    got = search.fuzzy_search_many(skills, queries, 1).collect()
    assert {(r.query, r.skill_id, r.score, r["rank"]) for r in got} == {(f"x{n}", i, 2.0, 1) for i, n in enumerate(names)}


def test_fuzzy_search_of_nothing(spark):
    skills = spark.createDataFrame([(1, "abc", ["abd"], None)], "skill_id int, preferred_label string, alternative_labels array<string>, description string")
    queries = spark.createDataFrame([("abc",), (None,)], "query string")
    assert [tuple(r) for r in search.fuzzy_search_many(skills, queries, 3).collect()] == [("abc", 1, 3.0, 1)]
    assert tuples(search.fuzzy_search_many(skills, queries, 0)) == []
    assert tuples(search.fuzzy_search_many(skills.limit(0), queries, 3)) == tuples(search.fuzzy_search_many(skills, queries.limit(0), 3)) == []
