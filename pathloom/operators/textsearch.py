"""Search of many names at once: gram and deletion indexes, BM25, rank fusion, and search by sentence."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.models import Encoder, encode
from pathloom.functions.vectors import cosine_top_k, dealt
from pathloom.lineage import cut_lineage

#: Between words: what is neither a letter nor a digit.
BETWEEN = r"[^\p{L}\p{N}]+"


def grams(text: Column, least: int = 1) -> Column:
    """All different stretches of `least` to 3 characters, and the empty one."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *(one(n) for n in range(least, 4))))


def pattern_grams(name: Column) -> Column:
    """Grams that every text matched by %name% has, lower case: of each stretch without wildcards all of 3 characters, or itself if it is shorter."""
    parts = F.split(F.lower(name), r"\\.|[%_\\]")
    of = lambda part: F.when(F.length(part) <= 3, F.array(part)).otherwise(F.filter(grams(part, 3), lambda g: F.length(g) == 3))
    return F.array_distinct(F.flatten(F.transform(parts, of)))


def candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """name, skill_id: for each name the skills of which some text has the rarest of its grams; all that match are among them.

    texts: skill_id, text (a row for each text of a skill); names: name. Only grams that a name has are counted and joined,
    and of these only the rarest of each name meets its postings.
    """
    wanted = cut_lineage(names.select("name").filter("name is not null").distinct().select("name", F.explode(pattern_grams(F.col("name"))).alias("gram")))
    texts = texts.filter("text is not null").select("skill_id", F.lower("text").alias("text"))
    # a text's grams are those of three lengths; each stays only if a name has it
    postings = cut_lineage(texts.select("skill_id", F.explode(grams(F.col("text"))).alias("gram")).join(wanted.select("gram"), "gram", "left_semi").distinct())
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    return rarest.filter("r.n > 0").select("name", F.col("r.gram").alias("gram")).join(postings, "gram").select("name", "skill_id")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")


def allowed_edits(word: Column) -> Column:
    """0, 1 or 2 edits for words of up to 2, up to 5, and more letters."""
    return F.when(F.length(word) <= 2, 0).when(F.length(word) <= 5, 1).otherwise(2)


def deletions(word: Column, most: Column, prefix: int = 10) -> Column:
    """The word's first `prefix` characters without up to `most` (0 to 2) of them. Two words within `most` edits have such a form in common."""
    head = F.substring(word, 1, prefix)
    without = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = F.when(most >= 1, without(head)).otherwise(F.array().cast("array<string>"))
    two = F.when(most >= 2, F.flatten(F.transform(without(head), without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(head), one, two))


def fuzzy_hits(texts: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """query, skill_id, score: the weights of the texts that have a word near a word of the query, summed over its words.

    texts: skill_id, text, weight (above 0), column (which text of the skill it is); queries: query. Near is up to 0, 1 or 2 edits by the asked word's length.
    Different words of the texts and of the queries meet on forms with letters taken away, and the distance is checked.
    With k, the k best of each query are among the rows, and where pairs of queries and skills are many they are not shuffled: scores are
    summed in blocks of skills, and only the k best of each query and block are returned.
    """
    asked = cut_lineage(queries.select("query").filter("query is not null").distinct().select("query", F.explode(F.array_distinct(words_of(F.col("query")))).alias("asked")))
    postings = cut_lineage(texts.select("skill_id", "column", "weight", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")))
    words, shared = postings.select("word").distinct(), asked.groupBy("asked").agg(F.count(F.lit(1)).alias("n_queries"))
    forms = lambda df, c, most: df.select("*", F.explode(deletions(F.col(c), most)).alias("form"))
    met = forms(words, "word", F.lit(2)).join(forms(shared, "asked", allowed_edits(F.col("asked"))), "form").select("word", "asked", "n_queries").distinct()
    # written, so that Spark knows its size ahead of the join and shuffles the postings only if it is large
    near = cut_lineage(met.filter(F.levenshtein("asked", "word") <= allowed_edits(F.col("asked"))))
    hits = postings.join(near, "word").select("skill_id", "column", "weight", "asked", "n_queries").distinct()
    if k is not None:
        seen = Observation()
        hits = cut_lineage(hits.observe(seen, F.count(F.lit(1)).alias("hits"), F.coalesce(F.sum("n_queries"), F.lit(0)).alias("pairs")))
        n_asked, n_hits, n_pairs = asked.count(), seen.get["hits"], seen.get["pairs"]
        blocks, slices = blocks_and_slices(texts.sparkSession, n_asked, n_hits, k)
    if k is None or n_pairs <= n_hits * slices + n_asked * blocks:
        return asked.join(hits, "asked").groupBy("query", "skill_id").agg(F.sum("weight").cast("double").alias("score"))
    weighed = hits.select(F.col("skill_id").alias("id"), F.col("asked").alias("term"), F.col("weight").cast("double").alias("w"))
    found = best_in_blocks(asked.select(F.col("query").alias("query_id"), F.col("asked").alias("term")), weighed, blocks, slices, k)
    return found.select(F.col("query_id").alias("query"), F.col("item_id").alias("skill_id"), "score")


def best_of_each(found: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """The k rows of the highest score for each key, with their rank; ties go to the smaller item."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), item))).filter(F.col("rank") <= k)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


#: In term_counts the term of rows that tell of all items of a batch; no text has it.
TOTAL = ""


def term_counts(items: DataFrame) -> DataFrame:
    """term, item_id, tf, length of items (item_id, text), counted row by row, so no word is shuffled. Rows of the term TOTAL have no
    item: tf is a number of items, with or without terms, length that of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [pa.array([TOTAL]), pa.nulls(1, batch.column(0).type), pa.array([batch.num_rows], pa.int64()), pa.array([len(pc.list_flatten(batch.column(1)))], pa.int32())]
            yield pa.RecordBatch.from_arrays(total, ["term", "item_id", "tf", "length"])
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                words, of = pc.list_flatten(part.column(1)).dictionary_encode(), pc.list_parent_indices(part.column(1)).to_numpy(zero_copy_only=False)
                n = max(1, len(words.dictionary))
                pairs, tf = np.unique(of.astype(np.int64) * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                rows = pa.array(pairs // n)
                length = pc.list_value_length(part.column(1)).take(rows)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(pairs % n)), part.column(0).take(rows), pa.array(tf, pa.int64()), length.cast(pa.int32())], ["term", "item_id", "tf", "length"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", terms(F.col("text")).alias("t")).mapInArrow(run, f"term string, item_id {kind}, tf bigint, length int")


def bm25_top_k(queries: DataFrame, items: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, digits: int | None = None, query_words: int = 200_000, item_words: int = 500_000) -> DataFrame:
    """query_id, item_id, score, rank of the k items of the highest BM25 score for each query; ties go to the smaller item_id.

    queries: query_id, text; items: item_id, text. A query's different words count once. Only postings of words that a query has
    are weighed. Scores are summed in no order of its own; with `digits` they are rounded before they are ranked.

    Blocks of items meet slices of queries, each in a key of its own; scores are summed there, and k rows leave it for each query. A block has about
    item_words postings, a slice query_words words of queries, fewer if k is large.
    """
    spark, k = items.sparkSession, max(1, k)
    asked = cut_lineage(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct())
    wanted = asked.select("term").distinct().unionByName(spark.range(1).select(F.lit(TOTAL).alias("term")))
    found = cut_lineage(term_counts(items).join(wanted, "term", "left_semi"))
    # how many items have each term, how many there are and how long they are: all from one pass over the items
    counts = cut_lineage(found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.sum("length").alias("length")))
    is_word = F.col("term") != TOTAL
    n_items, n_terms, n_words = (n or 0 for n in counts.agg(F.sum(F.when(~is_word, F.col("tf"))), F.sum(F.when(~is_word, F.col("length"))), F.sum(F.when(is_word, F.col("df")))).first())
    mean = n_terms / n_items if n_items else None
    own, counts = found.filter(is_word), counts.select("term", "df")
    idf = F.log(1 + (F.lit(n_items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    weighed = own.join(counts, "term").select(F.col("item_id").alias("id"), "term", weight.alias("w"))
    blocks, slices = blocks_and_slices(spark, asked.count(), n_words, k, query_words, item_words)
    return best_of_each(best_in_blocks(asked, weighed, blocks, slices, k, digits), "query_id", "item_id", k)


def blocks_and_slices(spark: SparkSession, n_asked: int, n_words: int, k: int, query_words: int = 200_000, item_words: int = 500_000) -> tuple[int, int]:
    """Into how many blocks n_words postings are dealt, and into how many slices n_asked words of queries."""
    blocks = max(-(-n_words // item_words), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // 20_000)), 1)
    return blocks, max(1, -(-n_asked // min(query_words, max(1000, (1 << 21) // max(1, k)))))


def best_in_blocks(asked: DataFrame, weighed: DataFrame, blocks: int, slices: int, k: int, digits: int | None = None) -> DataFrame:
    """query_id, item_id, score: the k items of the highest sum of weights (above 0) for each query and block of items, ties to the smaller id.

    asked: query_id, term; weighed: id, term, w of an item. Both sides are shuffled as rows to the pairs of a block and a slice.
    """
    k = max(1, k)
    kinds = (asked.schema["query_id"].dataType.simpleString(), weighed.schema["id"].dataType.simpleString())
    left = dealt(asked.select(F.col("query_id").alias("id"), "term"), "slice", slices, "block", blocks).groupBy("block", "slice")
    right = dealt(weighed, "block", blocks, "slice", slices).groupBy("block", "slice")
    return left.cogroup(right).applyInArrow(_best_by_words(k, digits), f"query_id {kinds[0]}, item_id {kinds[1]}, score double")


def _best_by_words(k: int, digits: int | None):
    def numbered(rows: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray]:
        """The rows by id, the different ids in order, and for each row the place of its id among them."""
        rows = rows.take(pc.sort_indices(rows.column("id"), null_placement="at_start"))
        ids = rows.column("id").combine_chunks()
        ids = (ids if len(ids) else pa.array([], ids.type)).dictionary_encode("encode")
        return rows, ids.dictionary, ids.indices.to_numpy(zero_copy_only=False)

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        ours, queries, query = numbered(ours)
        theirs, items, item = numbered(theirs)
        words = pa.concat_arrays([*ours.column("term").chunks, *theirs.column("term").chunks]).dictionary_encode() if len(ours) and len(theirs) else None
        found_q, found_i, found_s = [], [], []
        if words is not None:
            code = words.indices.to_numpy(zero_copy_only=False)
            term, w = code[len(ours) :], theirs.column("w").to_numpy()
            order = np.argsort(term, kind="stable")
            item, w, first = item[order], w[order], np.searchsorted(term[order], np.arange(len(words.dictionary) + 1))
            scores = np.zeros(len(items))
            starts = np.searchsorted(query, np.arange(len(queries) + 1))
            for q in range(len(queries)):
                for t in code[starts[q] : starts[q + 1]]:
                    at = slice(first[t], first[t + 1])
                    np.add.at(scores, item[at], w[at])
                hits = np.flatnonzero(scores)
                s = scores[hits]
                scores[hits] = 0.0
                if digits is not None:
                    s = np.round(s, digits) + 0.0
                if len(s) > k:
                    some = s >= np.partition(s, -k)[-k]
                    hits, s = hits[some], s[some]
                best = np.argsort(-s, kind="stable")[:k]
                found_q.append(np.full(len(best), q))
                found_i.append(hits[best])
                found_s.append(s[best])
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
        return pa.table({"query_id": queries.take(pa.array(join(found_q, np.int64))), "item_id": items.take(pa.array(join(found_i, np.int64))), "score": join(found_s, np.float64)})

    return run


def fused(rankings: list[DataFrame], k: int, constant: int = 60, digits: int | None = None) -> DataFrame:
    """query_id, item_id, score, rank by reciprocal rank fusion: the sum of 1 / (constant + rank) over the rankings (query_id, item_id, rank)."""
    parts = [r.select("query_id", "item_id", (1 / (F.lit(constant) + F.col("rank"))).alias("s")) for r in rankings]
    both = functools.reduce(DataFrame.unionByName, parts).groupBy("query_id", "item_id").agg(F.sum("s").alias("score"))
    if digits is not None:
        both = both.withColumn("score", F.round("score", digits))
    return best_of_each(both, "query_id", "item_id", k)


def phase_one(queries: DataFrame, items: DataFrame, k: int = 100, each: int = 200, constant: int = 60, digits: int | None = None) -> DataFrame:
    """query_id, item_id, score, rank: the `each` best by words and the `each` best by vector, fused to k.

    queries: query_id, text, vector; items: item_id, text, vector. The vector search is exact; an index's approximate_top_k fits in as another ranking.
    """
    queries = cut_lineage(queries.select("query_id", "text", "vector"))  # few beside the items, and asked twice
    by_words = bm25_top_k(queries, items, each, digits=digits)
    by_vector = cosine_top_k(queries.select(F.col("query_id").alias("id"), "vector"), items.select(F.col("item_id").alias("id"), "vector"), each, digits)
    return fused([by_words, by_vector], k, constant, digits)


def semantic_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, unit_no (from 0), unit: the sentences of a text, ended by . ! ? or a line, without white space around; empty ones are left out."""
    units = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])\s+|\n+"), lambda u: F.trim(u)), lambda u: u != "")
    return df.select(key, F.posexplode(units).alias("unit_no", "unit"))


def search_by_units(queries: DataFrame, items: DataFrame, encoder: Encoder, k: int, digits: int | None = None) -> DataFrame:
    """query_id, item_id, score, rank, unit: items (id, vector) by the best cosine of any sentence of a query's text (query_id, text), and that sentence.

    Different sentences are encoded and searched once. The k best by the maximum over units are among the k best of each unit.
    """
    units = cut_lineage(semantic_units(queries, "query_id", "text").select("query_id", "unit").distinct())
    vectors = encode(units.select("unit").distinct(), "unit", "vector", encoder).select(F.col("unit").alias("id"), "vector")
    found = cosine_top_k(vectors, items, k, digits).select(F.col("query_id").alias("unit"), "item_id", "score")
    best = units.join(found, "unit").groupBy("query_id", "item_id").agg(F.max("score").alias("score"), F.min_by("unit", F.struct(-F.col("score"), "unit")).alias("unit"))
    return best_of_each(best, "query_id", "item_id", k)
