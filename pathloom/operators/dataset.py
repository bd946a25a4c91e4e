"""Training sets: triplets, splits and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions import text
from pathloom.lineage import cut_lineage
from pathloom.sources.sinks import first_by, last_by


def numbered_in_group(df: DataFrame, key: str, seq: str, name: str) -> DataFrame:
    """Adds name: 0, 1, ... among the rows of a key in order of seq.

    Keys are few and their rows have no bound, so all rows are dealt by ranges of (key, seq), numbered within each range and
    moved by the sizes of the ranges before them; no task has a whole key. There are as many ranges as shuffle partitions.
    """
    ranged = df.repartitionByRange(key, seq).sortWithinPartitions(key, seq)
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each key and range
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_sum_before"))
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(seq)) - 1
    joined = ranged.withColumn("_local", local).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_sum_before") + F.col("_local")).drop("_key", "_p", "_part", "_local", "_sum_before")


def grouped_lists(df: DataFrame, key: str, value: str, seq: str, most: int = 1000) -> DataFrame:
    """key, part and the list of values in order of seq, `most` to a row: part 0 has the first, and so on."""
    rows = numbered_in_group(df.select(key, *{value, seq}), key, seq, "_i").withColumn("part", F.floor(F.col("_i") / most))
    lists = rows.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("s"), F.col(value).alias("v")))).alias("r"))
    return lists.select(key, "part", F.transform("r", lambda x: x["v"]).alias(f"{value}_list"))


def to_triplets(samples: DataFrame, group: str, seq: str) -> DataFrame:
    """Adds negative: the i-th sample of a group gets the i-th of the negatives of the group's first sample, around and around; '' if there are none.

    samples: group, seq, query, positive, negatives.
    """
    pool = samples.groupBy(group).agg(F.min_by(F.coalesce("negatives", F.array().cast("array<string>")), F.col(seq)).alias("_pool"))
    joined = numbered_in_group(samples, group, seq, "_i").join(pool, group)
    pick = F.when(F.size("_pool") == 0, F.lit("")).otherwise(F.try_element_at("_pool", (F.col("_i") % F.greatest(F.size("_pool"), F.lit(1)) + 1).cast("int")))
    return joined.withColumn("negative", pick).drop("_i", "_pool")


def drop_repeated(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by seq."""
    return first_by(df, keys, seq)


def split_by_group(df: DataFrame, group: str, seq: str, test_rows: int, seed: int = 42, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) without a group in both.

    Groups are taken in the order of the MD5 of seed and key (or `order`) until they have test_rows rows. The test set is cut to just
    that many; the rows cut off belong to a test group and are in neither set.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit("")))) if order is None else order
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_order", order)
    # running sizes decide which groups the test set takes: test_rows groups at most, as each has a row
    before = F.sum("_n").over(Window.orderBy("_order", group).rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.orderBy("_order", group).limit(max(test_rows, 0))
    taken = first.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < test_rows).select(group, "_before")
    test = numbered_in_group(df.join(taken, group), group, seq, "_i")
    train = df.join(taken.select(group), group, "left_anti")
    return train, test.filter(F.col("_before") + F.col("_i") < test_rows).drop("_before", "_i")


def extended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """An existing data set with the new samples behind it; nothing is dropped as repeated."""
    return existing.unionByName(new, allowMissingColumns=True)


def shared_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Must be empty."""
    return train.select(group).intersect(test.select(group))


def dataset_stats(df: DataFrame, group: str, rows_before: int | None = None) -> DataFrame:
    """n_rows, n_groups, per_group, n_removed."""
    n = F.count(F.lit(1))
    groups = F.count_distinct(group)
    return df.agg(n.alias("n_rows"), groups.alias("n_groups"), F.coalesce(F.round(n / F.nullif(groups, F.lit(0)), 6), F.lit(0.0)).alias("per_group"), (F.lit(rows_before).cast("long") - n if rows_before is not None else F.lit(0).cast("long")).alias("n_removed"))


def unprocessed(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return all_rows.join(done.select(key), key, "left_anti")


def combine_positives_negatives(positives: DataFrame, negatives: DataFrame, key: str, seq: str) -> DataFrame:
    """Positives with the last negatives of their key; keys without negatives go."""
    return positives.join(last_by(negatives, [key], seq).drop(seq), key)


def generated_samples(results: DataFrame, variations: int = 3) -> DataFrame:
    """Samples of generation results (skill_uri, success, variations, negatives, ...): successful ones with three negatives or more; the i-th variation gets the i-th negative."""
    good = results.filter("success and size(variations) > 0 and size(negatives) >= 3")
    rows = good.select("*", F.posexplode(F.slice("variations", 1, variations)).alias("i", "query"))
    return rows.withColumn("negative", F.try_element_at("negatives", F.col("i") + 1)).filter("negative is not null").drop("variations", "negatives")


def parse_answers(answers: DataFrame, schema: str) -> DataFrame:
    """Adds parsed (null if it is not the JSON asked for) to a column `answer`, with or without a code fence."""
    return answers.withColumn("parsed", F.from_json(text.strip_fence(F.col("answer")), schema))


def join_answers(answers: DataFrame, metadata: DataFrame) -> DataFrame:
    return answers.join(metadata, "key")


def training_rows(samples: DataFrame) -> DataFrame:
    """query, positive, negatives, cleaned; rows without query or positive go, and negatives that are empty."""
    out = samples.select(text.strip(F.col("query")).alias("query"), text.drop_nan_words(F.col("positive")).alias("positive"), F.filter(F.coalesce("negatives", F.array().cast("array<string>")), lambda x: x != "").alias("negatives"))
    return out.filter("query <> '' and positive <> ''")


def generation_stats(results: DataFrame) -> DataFrame:
    """n_skills, n_success, success_rate, over all results."""
    ok = F.count_if(F.coalesce("success", F.lit(False)))
    n = F.count(F.lit(1))
    return results.agg(n.alias("n_skills"), ok.alias("n_success"), F.coalesce(ok / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("success_rate"))


def numbered_batches(df: DataFrame, seq: str, size: int) -> DataFrame:
    """Adds batch: rows in order of seq, whose values may have gaps, cut into batches of `size`, the last one of what is left."""
    rows = numbered_in_group(df.withColumn("_all", F.lit(0)), "_all", seq, "_n")
    return rows.withColumn("batch", F.floor(F.col("_n") / size)).drop("_all", "_n")
