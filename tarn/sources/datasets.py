"""Preparing evaluation data: pages that an expected page may mean, page inference, request grouping, cases, YAML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import squash
from tarn.scratch import materialize


def page_candidates(page: Column, kind: Column) -> Column:
    """Pages that a number may mean: normalized means itself, raw (from 0) itself or the next, ambiguous its neighbours too."""
    return F.filter(F.when(kind == "normalized", F.array(page)).when(kind == "raw", F.array(page, page + 1)).otherwise(F.array(page - 1, page, page + 1)), lambda p: p >= 0)


def pages_in(text: Column) -> Column:
    """Page numbers in a text such as "pp. 12-14, 20"; the ends of a range count."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int")))


def page_overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Page ranges that overlap; ends may come in either order, a missing end is the start."""
    (lo, hi), (other_lo, other_hi) = ordered_range(start, end), ordered_range(other_start, other_end)
    return (lo <= other_hi) & (hi >= other_lo)


def ordered_range(start: Column, end: Column) -> tuple[Column, Column]:
    """A range's lower and upper end; ends may come in either order, a missing end is the start."""
    return F.least(start, F.coalesce(end, start)), F.greatest(start, F.coalesce(end, start))


def _bin(value: Column, width: int) -> Column:
    return F.floor(value / width).cast("long")


def overlapping(left: DataFrame, right: DataFrame, key: str, bin_width: int, most: int = 4_000, task_pairs: int = 30_000_000) -> DataFrame:
    """Rows of two tables of ranges (key, lo, hi and other columns; whole numbers, lo <= hi) that share a key and overlap. The second table's
    lo and hi are called other_lo and other_hi; other columns of both must differ in name. Rows with a null key or end overlap nothing.

    An interval join by bins: a range is in each bin of ``bin_width`` numbers that it touches, ranges meet in equal bins, and a pair
    counts in the first bin that both touch. So ranges far apart are never compared, and what is compared beyond the result are neighbours
    within a bin. A bin with more than ``most`` ranges of a table has them dealt to as many rows or columns of a grid as they fill, and the
    other table's ranges go to each. Cells of grids are dealt to tasks by the pairs they compare, about ``task_pairs`` each, whatever
    the bytes of the tables, and a task holds one cell's second ranges.
    """
    at = lambda c: _bin(F.col(c), bin_width)
    binned = lambda df, lo, hi, own: df.filter(F.col(lo) <= F.col(hi)).withColumn(own, at(lo)).withColumn("_bin", F.explode(F.sequence(own, at(hi))))
    first = binned(left, "lo", "hi", "_from")
    second = binned(right.withColumnsRenamed({"lo": "other_lo", "hi": "other_hi"}), "other_lo", "other_hi", "_other_from")
    counted = lambda df, n: df.groupBy(key, "_bin").agg(F.count("*").alias(n))
    bins = materialize(counted(first, "_n").join(counted(second, "_m"), [key, "_bin"]), "range-bins")
    compared = bins.agg(F.sum(F.col("_n").cast("double") * F.col("_m")), F.sum(F.col("_n") + F.col("_m"))).first()
    least = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * left.sparkSession.sparkContext.defaultParallelism)
    tasks = max(least, int((compared[0] or 0) / task_pairs), (compared[1] or 0) >> 20)
    bins = bins.select(key, "_bin", F.ceil(F.col("_n") / most).cast("int").alias("_p"), F.ceil(F.col("_m") / most).cast("int").alias("_q"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda df, n, columns: df.withColumn(f"{n}_at", F.pmod(F.xxhash64(*columns), F.col(n)).cast("int"))
    cell = [key, "_bin", "_p_at", "_q_at"]
    first = dealt(first.join(bins, [key, "_bin"]), "_p", left.columns).withColumn("_q_at", each("_q")).drop("_p", "_q")
    second = dealt(second.join(bins, [key, "_bin"]), "_q", [c for c in second.columns if c[0] != "_"]).withColumn("_p_at", each("_p")).drop("_p", "_q")
    met = first.repartition(tasks, *cell).hint("merge").join(second.repartition(tasks, *cell), cell)
    met = met.filter((F.col("lo") <= F.col("other_hi")) & (F.col("other_lo") <= F.col("hi")) & (F.col("_bin") == F.greatest("_from", "_other_from")))
    return met.drop("_bin", "_p_at", "_q_at", "_from", "_other_from")


def overlap_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The first table with n: how many of the second table's ranges with its key overlap each of its ranges. No pair is made.

    Ranges that overlap [lo, hi] are those that start at hi or before, less those that end before lo. Starts and ends are counted by key and
    number (map-side), and summed up over a key's distinct numbers; each range looks two sums up. Null keys and ends overlap nothing.
    """
    marks = right.filter("lo <= hi").select(key, F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct((F.col("hi") + 1).alias("x"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("m"))
    asked = left.filter("lo <= hi").select(key, F.explode(F.array("lo", "hi")).alias("x"))
    marks = marks.select(key, F.col("m.x").cast("long").alias("x"), "m.s", "m.e").unionByName(asked.select(key, F.col("x").cast("long").alias("x"), F.lit(0).alias("s"), F.lit(0).alias("e")))
    upto = Window.partitionBy(key).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    sums = marks.groupBy(key, "x").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    sums = materialize(sums.select(F.col(key).alias("_k"), "x", F.sum("s").over(upto).alias("started"), F.sum("e").over(upto).alias("ended")), "range-sums")
    started = sums.select("_k", F.col("x").alias("_x"), "started")
    ended = sums.select(F.col("_k").alias("_k2"), F.col("x").alias("_x2"), "ended")
    rows = left.join(started, (F.col(key) == F.col("_k")) & (F.col("hi") == F.col("_x")) & (F.col("lo") <= F.col("hi")), "left")
    rows = rows.join(ended, (F.col(key) == F.col("_k2")) & (F.col("lo") == F.col("_x2")) & (F.col("lo") <= F.col("hi")), "left")
    return rows.select(*left.columns, F.coalesce(F.col("started") - F.col("ended"), F.lit(0)).alias("n"))


def _match(needle: Column, page: Column, base: int) -> Column:
    """base + 10 if equal, base if the page holds the text, base - 5 if a page of 200 characters or more is part of it, else 0."""
    hit = F.when(needle == page, base + 10).when(page.contains(needle), base).when((F.length(page) >= 200) & needle.contains(page), base - 5).otherwise(0)
    return F.when(F.coalesce(needle, F.lit("")) == "", 0).otherwise(hit)


def _windows(needle: Column, page: Column, width: int = 180) -> Column:
    """For texts of 240 characters or more: 40, and 10 for each of start, middle and end that the page holds."""
    half = F.floor(F.length(needle) / 2).cast("int")
    parts = F.array(F.left(needle, F.lit(width)), F.substring(needle, half + 1, F.lit(width)), F.right(needle, F.lit(width)))
    hits = F.size(F.filter(parts, lambda w: page.contains(w)))
    return F.when((F.length(needle) >= 240) & (hits > 0), 40 + 10 * hits).otherwise(0)


def infer_pages(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """(case_id, page, score): the page of the case's document that fits its evidence best.

    cases: case_id, doc_id, full_page, evidence, raw_page; pages: doc_id, page, text. The full page's text scores 100, 90
    or 85, the evidence 80, 70 or 65, or by its windows. Ties: distance from the raw page (give or take one), then the
    page. The join is by document.
    """
    norm = lambda c: F.lower(squash(F.col(c)))
    rows = cases.select("case_id", "doc_id", "raw_page", norm("full_page").alias("f"), norm("evidence").alias("e")).join(pages.select("doc_id", "page", norm("text").alias("t")), "doc_id").filter("t <> ''")
    score = F.greatest(_match(F.col("f"), F.col("t"), 90), _match(F.col("e"), F.col("t"), 70), F.coalesce(_windows(F.col("e"), F.col("t")), F.lit(0)))
    away = F.array_min(F.transform(F.array(F.lit(0), F.lit(1), F.lit(-1)), lambda o: F.abs(F.col("page") - F.col("raw_page") - o)))
    rows = rows.withColumn("score", score).withColumn("away", F.coalesce(away, F.lit(0))).filter("score > 0")
    best = rows.groupBy("case_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "away", "page")).alias("b"))
    return best.select("case_id", F.col("b.page").alias("page"), (-F.col("b.s")).alias("score"))


def group_requests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, conflicts) of rows (row_id, doc_name, link): one request per document with its rows; documents with
    several links are conflicts."""
    grouped = rows.groupBy("doc_name").agg(F.min("link").alias("link"), F.count_distinct("link").alias("links"), F.array_sort(F.collect_list("row_id")).alias("row_ids"))
    return grouped.filter("links <= 1").drop("links"), grouped.filter("links > 1").select("doc_name", "links", "row_ids")


def hint_key(hint: Column) -> Column:
    """Letters and digits of a document hint's last part, without query and fragment; unlike a document's key it keeps the suffix."""
    plain = F.regexp_replace(F.split_part(F.split_part(F.lower(F.trim(hint)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/+$", "")
    return F.regexp_replace(F.regexp_replace(plain, "^.*/", ""), "[^a-z0-9]+", "")


def hinted_documents(hints: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, doc_id): documents (doc_id, name) whose key equals a case's hint (case_id, hint), holds it, or is held by it."""
    from tarn.operators.retrieval import either_holds

    h = hints.select("case_id", hint_key(F.col("hint")).alias("key")).distinct()
    d = documents.select("doc_id", hint_key(F.col("name")).alias("name_key")).distinct()
    return either_holds(h, d, "key", "name_key").select("case_id", "doc_id").distinct()


def explode_evidence(cases: DataFrame) -> DataFrame:
    """(case_id, position, doc_name, full_page, evidence, raw_page) of cases whose evidence is an array of such structs; a case without any has none."""
    return cases.select("case_id", F.posexplode("evidence").alias("position", "e")).select("case_id", "position", "e.*")


def build_cases(rows: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(case_id, doc_id, question, page, page_score) of rows (case_id, doc_name, question, full_page, evidence, raw_page).

    Documents are found by canonical name, else by hints that hold one another (the smallest id of several).
    """
    from tarn.functions.text import document_key

    named = documents.select(document_key(F.col("doc_name")).alias("key"), F.col("doc_id").alias("by_name")).groupBy("key").agg(F.min("by_name").alias("by_name"))
    cases = rows.withColumn("key", document_key(F.col("doc_name"))).join(named, "key", "left")
    hints = hinted_documents(cases.filter("by_name IS NULL").select("case_id", F.col("doc_name").alias("hint")), documents.select("doc_id", F.col("doc_name").alias("name")))
    cases = cases.join(hints.groupBy("case_id").agg(F.min("doc_id").alias("by_hint")), "case_id", "left").withColumn("doc_id", F.coalesce("by_name", "by_hint"))
    inferred = infer_pages(cases.filter("doc_id IS NOT NULL"), pages)
    return cases.join(inferred, "case_id", "left").select("case_id", "doc_id", "question", F.coalesce("page", "raw_page").alias("page"), F.col("score").alias("page_score"))


def read_yaml(spark: SparkSession, path: str) -> list | dict:
    """A YAML file of cases or metrics; such files are configuration, so they are read whole on the driver."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
