"""Text composition and cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(col: Column) -> Column:
    """Without white space at both ends, Unicode's included; trim() takes spaces only."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def split_labels(col: Column, separator: str = "|") -> Column:
    """Labels of a joined string, stripped, empty ones dropped; null gives no labels."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), "\\Q" + separator + "\\E"), strip)
    return F.filter(parts, lambda x: x != "")


def join_labels(col: Column, separator: str = "|") -> Column:
    """The reverse of split_labels: empty labels and nulls are left out, no labels give an empty string."""
    return F.coalesce(F.array_join(F.filter(col, lambda x: x != ""), separator), F.lit(""))


def pick_description(description: Column, definition: Column) -> Column:
    """The description; the definition only where the description is an empty string. A null stays null."""
    return F.when(description == "", empty_to_null(definition)).otherwise(description)


def is_described(description: Column, least: int = 10) -> Column:
    return F.coalesce(F.length(strip(description)) >= least, F.lit(False))


def skill_text(label: Column, description: Column, labels: Column) -> Column:
    """label. description. label; label -- empty parts are skipped."""
    return F.concat_ws(". ", empty_to_null(label), empty_to_null(description), empty_to_null(F.array_join(F.filter(labels, lambda x: x != ""), "; ")))


def course_skill_text(name: Column, description: Column, category: Column, bloom: Column, level: Column, title: Column) -> Column:
    """A course skill's text for embedding; a level of 0 counts, the title part is always there."""

    def part(prefix: str, col: Column) -> Column:
        return F.when(col != "", F.concat(F.lit(prefix), col))

    return F.concat_ws(
        ". ", empty_to_null(name), empty_to_null(description), part("Category: ", category), part("Bloom level: ", bloom), F.concat(F.lit("Proficiency: "), level.cast("string")),
        F.concat(F.lit("Course: "), F.coalesce(title, F.lit(""))),
    )


def generation_text(label: Column, *parts: Column) -> Column:
    """The non-empty stripped parts joined by a space, else the label."""
    return F.coalesce(empty_to_null(F.concat_ws(" ", *(empty_to_null(strip(p)) for p in parts))), label)


def title_case(col: Column) -> Column:
    """Upper case for every letter that no letter stands before, lower case for the others."""
    chars = F.split(col, "")

    def cased(cs: Column) -> Column:
        return F.transform(cs, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(cs, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(F.lower(c)))

    return F.array_join(let(chars, cased), "")


def semantic_document(label: Column, description: Column, labels: Column, group: Column) -> Column:
    """Title: description. Also known as a, b. Belongs to group -- the last two only where there is something to tell."""
    known = empty_to_null(F.array_join(F.filter(labels, lambda x: x != ""), ", "))
    return F.concat(
        title_case(label), F.lit(": "), F.coalesce(description, F.lit("")), F.coalesce(F.concat(F.lit(". Also known as "), known), F.lit("")),
        F.coalesce(F.concat(F.lit(". Belongs to "), empty_to_null(group)), F.lit("")),
    )


def strip_fence(col: Column) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(col), r"^```(?:json)?", ""), r"```$", ""))


def drop_nan_words(col: Column) -> Column:
    return strip(F.replace(F.coalesce(col, F.lit("")), F.lit("nan nan"), F.lit("")))


def null_strings_to_null(df: DataFrame) -> DataFrame:
    """Every string that says "null", whatever its case and white space, becomes null, in structs and arrays too."""

    def clean(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.when(F.lower(strip(col)) == "null", F.lit(None)).otherwise(col)
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(col.isNotNull(), F.struct(*(clean(col[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return col

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
