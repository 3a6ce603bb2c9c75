"""Profiling text columns of a table: counts of what parses, inferred types, roles, cards, locators, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.numbers import parse_bool, parse_date, parse_number
from tarn.functions.text import column_name
from tarn.scratch import materialize


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, position, nulls, non_null, numeric, integers, booleans, dates, inferred_type): one pass over all columns.

    Blank cells are null. Precedence: empty, boolean, integer, number, date, string; so a column of 0 and 1 is boolean
    and one of years is integer.
    """
    columns = columns or df.columns
    aggregates = []
    for i, c in enumerate(columns):
        cell = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        number = parse_number(cell)
        n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
        aggregates.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(i).alias("position"),
                F.count_if(cell.isNull()).alias("nulls"),
                F.count(cell).alias("non_null"),
                n(number.isNotNull()).alias("numeric"),
                n(F.regexp_like(F.regexp_replace(cell, ",", ""), F.lit(r"^[+-]?\d+$"))).alias("integers"),
                n(parse_bool(cell).isNotNull()).alias("booleans"),
                n(parse_date(cell).isNotNull()).alias("dates"),
            ).alias(f"p{i}")
        )
    one = df.agg(*aggregates)
    rows = one.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(columns))])).alias("p")).select("p.*")
    return rows.withColumn("inferred_type", inferred_type())


def inferred_type() -> Column:
    whole = lambda c: F.col(c) == F.col("non_null")
    return (
        F.when(F.col("non_null") == 0, "empty").when(whole("booleans"), "boolean").when(whole("integers"), "integer").when(whole("numeric"), "number").when(whole("dates"), "date").otherwise("string")
    )


def type_histogram(profile: DataFrame) -> DataFrame:
    """(inferred_type, n), and all of them as one text is `type_line`."""
    return profile.groupBy("inferred_type").agg(F.count("*").alias("n"))


def type_line(profile: DataFrame) -> DataFrame:
    each = F.concat_ws("=", "inferred_type", F.col("n").cast("string"))
    return type_histogram(profile).agg(F.array_join(F.array_sort(F.collect_list(each)), ", ").alias("types"))


#: Words that tell a column's role, in order of precedence; those of measures need no whole word at the end.
ROLES = (
    ("period", r"\b(?:year|fy|fiscal|period|quarter|date|month)\b"),
    ("identifier", r"\b(?:id|identifier|code|ticker|symbol|cusip|isin)\b"),
    ("dimension", r"\b(?:company|segment|region|country|category|name)\b"),
    ("unit", r"\b(?:unit|currency|scale)\b"),
    ("measure", r"\b(?:amount|value|revenue|sales|income|expense|cash|asset|liabil|margin)\b"),
)


def semantic_role(name: Column) -> Column:
    """period, identifier, dimension, unit, measure or unknown, by the canonical name.

    Words are matched as whole names: an underscore is a word character, so fiscal_year is no period but year is.
    """
    n = column_name(name)
    found = F.lit("unknown")
    for role, pattern in reversed(ROLES):
        found = F.when(n.rlike(pattern), role).otherwise(found)
    return found


def unit_hint(name: Column) -> Column:
    """currency_usd, percent or shares by parts of the canonical name; null without any."""
    n = column_name(name)
    return F.when(n.rlike("usd|dollar"), "currency_usd").when(n.rlike("percent|pct|margin"), "percent").when(n.contains("share"), "shares")


def period_hint(name: Column) -> Column:
    """A year that is the whole canonical name: within longer names no word ends beside it."""
    return F.nullif(F.regexp_extract(column_name(name), r"\b((?:19|20)\d{2})\b", 1), F.lit(""))


def routing_cards(table_name: str, profile: DataFrame) -> DataFrame:
    """(card, column_name, text): one card for the table, one per column, one for the profile; no cell values."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]), ", ")
    table = profile.agg(names.alias("text")).select(F.lit("table").alias("card"), F.lit(None).cast("string").alias("column_name"), F.concat(F.lit(f"table {table_name}: "), "text").alias("text"))
    columns = profile.select(F.lit("column").alias("card"), "column_name", F.format_string("column %s of %s: %s", "column_name", F.lit(table_name), "inferred_type").alias("text"))
    total = type_line(profile).select(F.lit("profile").alias("card"), F.lit(None).cast("string").alias("column_name"), F.concat(F.lit("types: "), "types").alias("text"))
    return table.unionByName(columns).unionByName(total)




def row_locators(df: DataFrame, table_id: str, order: list[str], columns: list[str], header: bool = True) -> DataFrame:
    """(row_index, physical_row, row_hash, row_id) of rows in a given order.

    Rows are partitioned by ranges of the order and their hash, sorted within them and written with their places once; what stands in front of
    a range is added. So no window holds the whole table, equal keys are spread too, and where the ranges are cut changes no result.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    cells = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = df.select(*[F.col(c).alias(k) for k, c in zip(keys, order, strict=True)], F.sha2(cells, 256).alias("row_hash"))
    rows = rows.repartitionByRange(*keys, "row_hash").sortWithinPartitions(*keys, "row_hash")
    placed = materialize(rows.select("row_hash", F.monotonically_increasing_id().alias("at")), "ordered-rows")
    placed = placed.select("row_hash", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    in_front = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(in_front, F.lit(0)).alias("front"))  # a row a partition
    rows = placed.join(F.broadcast(counts), "range").select((F.col("front") + F.col("i") + 1).alias("row_index"), "row_hash")
    row_id = F.sha2(F.concat_ws("\x1f", F.lit(table_id), F.col("row_index").cast("string"), "row_hash"), 256)
    return rows.select("row_index", (F.col("row_index") + int(header)).alias("physical_row"), "row_hash", F.left(row_id, F.lit(32)).alias("row_id"))


def cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(row_key, column_name, raw_value, numeric_value): a table as cells."""
    text = df.select(F.col(key).alias("row_key"), *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(["row_key"], columns, "column_name", "raw_value").withColumn("numeric_value", parse_number(F.col("raw_value")))


def wide(cell_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as a table again: the numeric value if there is one, else the raw one; the columns are given, so one pass."""
    value = F.coalesce(F.col("numeric_value").cast("string"), F.col("raw_value"))
    return cell_rows.groupBy("row_key").pivot("column_name", columns).agg(F.first(value))


def financial_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, rejects) of rows (company, metric, period, value as text): facts need company, metric and a numeric value."""
    token = lambda c: F.regexp_replace(F.trim(F.lower(F.col(c))), r"\s+", "_")
    checked = rows.withColumn("number", parse_number(F.col("value")))
    reason = F.when(F.coalesce(F.trim("company"), F.lit("")) == "", "company").when(F.coalesce(F.trim("metric"), F.lit("")) == "", "metric").when(F.col("number").isNull(), "value")
    checked = checked.withColumn("reason", reason)
    facts = checked.filter("reason IS NULL").select(token("company").alias("company"), token("metric").alias("metric"), "period", F.col("number").alias("value"))
    return facts, checked.filter("reason IS NOT NULL").select("company", "metric", "period", "value", "reason")


def route_scores(cards: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, table_id, score, rank, margin, status): token overlap of questions with table cards (tables are few).

    cards: table_id, text, identifiers (array), numeric (boolean). Below 0.15 a question has no table; within 0.10 of
    the second it is ambiguous.
    """
    from tarn.operators.retrieval import small

    tokens = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z0-9_]+"), F.lit(0))), lambda w: F.length(w) > 1)
    q = questions.select("question_id", F.lower("text").alias("q"), tokens("text").alias("qt"))
    pairs = q.join(small(cards.select("table_id", "identifiers", "numeric", tokens("text").alias("tt"))))
    base = F.size(F.array_intersect("qt", "tt")) / F.greatest(F.lit(3), F.size("qt"))
    mention = F.exists("identifiers", lambda i: F.array_contains(F.col("qt"), F.lower(i)))
    score = F.round(F.least(F.lit(1.0), base + F.when(mention, 0.25).otherwise(0.0) + F.when(F.col("numeric"), 0.05).otherwise(0.0)), 6)
    rows = pairs.select("question_id", "table_id", score.alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "table_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.round(F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0)), 6))
    status = F.when(F.col("score") < 0.15, "no_match").when(F.col("margin") < 0.10, "ambiguous").otherwise("matched")
    return rows.filter("rank = 1").select("question_id", "table_id", "score", "margin", status.alias("status"))
