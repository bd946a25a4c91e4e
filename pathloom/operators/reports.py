"""Reports, checks and the joins of the exploration notebooks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pathloom import schemas
from pathloom.lineage import cut_lineage
from pathloom.sources.readers import require_columns
from pathloom.sources.sinks import first_by

#: Fixed patterns of law texts.
ARTICLE = r"(?iu)^Điều\s+(\d+)\s*[:.]?\s*(.*)$"
CLAUSE = r"^(\d+)\.\s+(.*)$"
REPORT = tuple(schemas.MAPPING.fieldNames())


def mapping_report(mappings: DataFrame, columns: tuple[str, ...] = REPORT) -> DataFrame:
    """The report's columns in order, the highest similarity first, nulls last; a missing column is an error."""
    return require_columns(mappings, list(columns)).select(*columns).orderBy(F.col("similarity_score").desc_nulls_last(), *columns[:3])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """status: healthy if every table has rows, else degraded; with the number of tables and of those with rows."""
    counts = table_counts(tables)
    ok = F.bool_and(F.col("n_rows") > 0)
    return counts.agg(F.when(F.coalesce(ok, F.lit(False)), "healthy").otherwise("degraded").alias("status"), F.count(F.lit(1)).alias("n_tables"), F.count_if(F.col("n_rows") > 0).alias("n_filled"))


def verify_report(skills: DataFrame, key: str, vector: str, sample: int = 5) -> DataFrame:
    """section, key, value: the numbers of rows and vectors, and a sample of rows with their vectors' sizes."""
    counts = skills.agg(F.count(F.lit(1)).alias("rows"), F.count(vector).alias("vectors"))
    totals = counts.select(F.explode(F.array(*(F.struct(F.lit("count").alias("section"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("rows", "vectors")))).alias("r")).select("r.*")
    some = skills.orderBy(key).limit(sample).select(F.lit("sample").alias("section"), F.col(key).cast("string").alias("key"), F.size(vector).cast("string").alias("value"))
    return totals.unionByName(some)


def left_merge_first(left: DataFrame, right: DataFrame, on: str, seq: str) -> DataFrame:
    """Left join with the first row of each key of the right side."""
    return left.join(first_by(right, [on], seq), on, "left")


def outer_merge(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full join with merge_side: both, left_only or right_only."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), F.col(left_key) == F.col(right_key), "full")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return joined.withColumn("merge_side", side).drop("_l", "_r")


def deepest(*levels: str) -> Column:
    """The last of the levels that isn't null."""
    return F.coalesce(*reversed(levels))


def dyadic_parts(first: Column, last: Column) -> Column:
    """The whole numbers from first to last as few stretches of 2^level numbers, part * 2^level being the first: (level, part), two of a level at most."""
    none = F.array().cast("array<struct<level: int, part: bigint>>")
    one = lambda level, part: F.array(F.struct(level.cast("int").alias("level"), part.alias("part")))
    odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1

    def step(s: Column, level: Column) -> Column:
        open_, low, high = s["low"] < s["high"], s["low"], s["high"]
        takes_low, takes_high = open_ & odd(low), open_ & odd(high)
        out = F.concat(s["out"], F.when(takes_low, one(level, low)).otherwise(none), F.when(takes_high, one(level, high - 1)).otherwise(none))
        low, high = low + F.when(takes_low, F.lit(1)).otherwise(F.lit(0)).cast("long"), high - F.when(takes_high, F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct(F.shiftright(low, 1).alias("low"), F.shiftright(high, 1).alias("high"), out.alias("out"))

    start = F.struct(first.cast("long").alias("low"), (last.cast("long") + 1).alias("high"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda s: s["out"])


def dealing(n: Column, m: Column, most: int) -> tuple[Column, Column]:
    """Into how many lots (_values, _ranges) n values and m ranges are dealt so that a lot of each makes about `most` pairs or less: n * _ranges +
    m * _values rows meet, which is one row or two for each value, or each range, until both are many, then one for some hundreds of pairs."""
    side = math.isqrt(max(1, most))
    lots = lambda x, y: F.when(y <= side, F.ceil(x * y / most)).otherwise(F.ceil(x / side))
    return F.when(n <= side, F.lit(1)).otherwise(lots(n, m)).cast("long").alias("_values"), F.when(m <= side, F.lit(1)).otherwise(lots(m, n)).cast("long").alias("_ranges")


def in_range(df: DataFrame, value: str, ranges: DataFrame, missing: str = "Not found", missing_no: int = -1, most: int = 4_000_000) -> DataFrame:
    """Adds chapter_name and chapter_number of the ranges (first, last, chapter_name, chapter_number; a document's table of contents) that hold value.

    A value in several ranges gives a row for each, one in none the defaults; bounds are whole numbers. A range is a few dyadic
    stretches, and a value is in one stretch of each length, so values meet ranges by an equi-join on (level, part), each pair
    that fits once, however long and many ranges are. Pairs are made in the last join and go nowhere from there; a stretch with more than `most` of
    them deals its values into lots, and its ranges too if there are many, so that neither side is repeated much.
    """
    at = ["_level", "_part"]
    parts = ranges.select("*", F.explode(dyadic_parts(F.ceil("first"), F.floor("last"))).alias("_d"))
    parts = cut_lineage(parts.select("first", "last", "chapter_name", "chapter_number", F.col("_d.level").alias("_level"), F.col("_d.part").alias("_part")))
    levels = [r[0] for r in parts.select("_level").distinct().collect()] or [0]  # 63 at most
    whole = F.floor("_value").cast("long")
    stretches = F.explode(F.array(*(F.struct(F.lit(n).alias("_level"), F.shiftright(whole, n).alias("_part")) for n in sorted(levels)))).alias("_d")
    values = df.select(F.col(value).alias("_value")).filter("_value is not null").distinct()
    sizes = parts.groupBy(*at).agg(F.count(F.lit(1)).alias("_ranges"))
    matched = cut_lineage(values.select("_value", stretches).select("_value", "_d.*").join(sizes, at))
    lots = cut_lineage(matched.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.max("_ranges").alias("_m")).select(*at, *dealing(F.col("_n"), F.col("_m"), most)))
    holds = F.col("_value").between(F.col("first"), F.col("last"))
    if isinstance(df.schema[value].dataType, IntegralType):  # in the stretch is in the range
        held = matched.select("_value").distinct()
    else:
        held = matched.join(parts.select(F.col("_level").alias("_l"), F.col("_part").alias("_p"), "first", "last"), (F.col("_level") == F.col("_l")) & (F.col("_part") == F.col("_p")) & holds, "left_semi").select("_value").distinct()
    own = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.col(n)).alias(n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n)
    asking = matched.drop("_ranges").join(lots, at).select("_value", *at, own("_values", "_value"), each("_ranges"))
    names = ("first", "last", "chapter_name", "chapter_number")
    telling = parts.join(lots, at).select(*names, *at, each("_values"), own("_ranges", *names))
    found = df.join(asking, F.col(value) == F.col("_value")).join(telling, [*at, "_values", "_ranges"]).filter(holds)
    none = df.join(held, F.col(value) == F.col("_value"), "left_anti").withColumns({"chapter_name": F.lit(missing), "chapter_number": F.lit(missing_no).cast(ranges.schema["chapter_number"].dataType)})
    names = {"chapter_name": F.coalesce("chapter_name", F.lit(missing)), "chapter_number": F.coalesce("chapter_number", F.lit(missing_no))}
    columns = [*df.columns, "chapter_name", "chapter_number"]
    return found.select(*columns).unionByName(none.select(*columns)).withColumns(names)


def article_of(clause_id: Column) -> Column:
    """The article's number in a clause id; null if it has none."""
    return F.regexp_extract(clause_id, r"_d(\d+)_k", 1).try_cast("int")


def expand_references(clauses: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """chunk_id, text with the texts of the clauses in `references` (array of chunk_id) behind it, in their order; of all
    clauses, or of those that `wanted` (chunk_id) names."""
    some = clauses if wanted is None else clauses.join(wanted.select("chunk_id"), "chunk_id", "left_semi")
    named = some.select("chunk_id", "text", F.posexplode_outer("references").alias("pos", "ref"))
    found = named.join(clauses.select(F.col("chunk_id").alias("ref"), F.col("text").alias("ref_text")), "ref", "left")
    lists = found.groupBy("chunk_id", "text").agg(F.array_sort(F.collect_list(F.when(F.col("ref_text").isNotNull(), F.struct("pos", "ref_text")))).alias("r"))
    return lists.select("chunk_id", F.concat_ws("\n", F.col("text"), F.array_join(F.transform("r", lambda x: x["ref_text"]), "\n")).alias("text"))


def law_clauses(texts: DataFrame) -> DataFrame:
    """source, article_number, article_title, clause_number, clause_text of law texts (source, text): articles begin with the word of ARTICLE and a number, clauses with "n.";
    lines that begin neither go on with what is before them, lines before the first article with nothing."""
    from pyspark.sql.window import Window

    lines = texts.select("source", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    article, clause = ARTICLE, CLAUSE
    number = lambda p, g=1: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    marked = lines.withColumns({"a": number(article).try_cast("int"), "title": number(article, 2), "c": number(clause).try_cast("int")})
    upto = Window.partitionBy("source").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)  # one law at a time
    state = marked.withColumns({"article_at": F.max(F.when(F.col("a").isNotNull(), F.col("no"))).over(upto), "article_number": F.last("a", True).over(upto), "article_title": F.last("title", True).over(upto)})
    inside = Window.partitionBy("source", "article_at").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    state = state.withColumn("clause_number", F.last("c", True).over(inside)).filter("article_number is not null and a is null")
    body = F.when(F.col("c").isNotNull(), number(clause, 2)).otherwise(F.col("line"))
    groups = state.groupBy("source", "article_number", "article_title", "clause_number").agg(F.array_sort(F.collect_list(F.struct("no", body.alias("t")))).alias("r"))
    return groups.select("source", "article_number", "article_title", "clause_number", F.array_join(F.transform("r", lambda x: x["t"]), " ").alias("clause_text"))
