"""Primitive-query files of exact rationals, their labels, and run exports.

Numerators and denominators stay strings, since they may exceed any integer
column; coordinates are their quotient as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of every file below ``path`` in order, blank ones left out.

    A file is one row until it is split, so numbering needs no shuffle; files
    hold a few thousand queries each.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    return files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(lines).alias("line", "value"))


def rational_queries(spark: SparkSession, path: str, columns: int = 7) -> DataFrame:
    """One query per eight lines of ``num,den,num,den,num,den[,truth]``: file, query_index, truth, v0..v23.

    Fails on a line of another width, a zero denominator, a leftover of fewer
    than eight lines, or truths that differ within a query.
    """
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = numbered_lines(spark, path).withColumn("p", parts)
    quotient = lambda i: F.col("p")[i].cast("double") / F.nullif(F.col("p")[i + 1].cast("double"), F.lit(0.0))
    truth = F.col("p")[6].cast("int") == 1 if columns == 7 else F.lit(None).cast("boolean")
    wide = F.assert_true(F.size("p") == columns, "a line has another number of values")
    point = F.struct(F.pmod("line", F.lit(8)).alias("i"), *[quotient(2 * k).alias(a) for k, a in enumerate("xyz")])
    rows = rows.withColumn("_ok", F.coalesce(wide.cast("string"), F.lit(""))).select("file", F.floor(F.col("line") / 8).alias("query_index"), point.alias("point"), truth.alias("truth"), "_ok")
    rows = rows.groupBy("file", "query_index").agg(
        F.array_sort(F.collect_list("point")).alias("v"), F.min("truth").alias("truth"), F.max("truth").alias("_most"), F.max("_ok").alias("_ok"), F.count("*").alias("_n")
    )
    fault = F.when(F.col("_n") != 8, F.lit("a query has not eight lines")).when(~F.col("truth").eqNullSafe(F.col("_most")), F.lit("truths differ within a query"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.col("truth"))
    values = [F.col("v")[i][a].alias(f"v{3 * i + j}") for i in range(8) for j, a in enumerate("xyz")]
    return rows.select("file", "query_index", checked.alias("truth"), *values)


def with_labels(queries: DataFrame, labels: DataFrame, mandatory: bool = False) -> DataFrame:
    """Joins (file, values array) by file stem and place; a query without a label keeps null.

    If labels are ``mandatory``, a file whose labels are not as many as its queries is an error.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    own = labels.select(name("file").alias("_stem"), F.posexplode("values").alias("query_index", "label"))
    named = queries.withColumn("_stem", name("file"))
    if mandatory:
        counts = named.groupBy("_stem").agg(F.count("*").alias("_queries"))
        sizes = labels.select(name("file").alias("_stem"), F.size("values").alias("_labels"))
        checked = counts.join(sizes, "_stem", "full").select("_stem", F.assert_true(F.col("_queries").eqNullSafe(F.col("_labels")), "labels are not as many as queries").alias("_ok"))
        own = own.join(checked, "_stem", "full").where(F.col("_ok").isNull()).drop("_ok")
    return named.join(own, ["_stem", "query_index"], "left").drop("_stem")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, values) of JSON files that hold one list of booleans each."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return text.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<boolean>").alias("values"))


def read_box_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, pairs) of JSON files that hold one list of pairs of box numbers each; another entry is an error when it is read."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<array<long>>").alias("pairs"))
    fits = F.col("pairs").isNotNull() & F.forall("pairs", lambda p: p.isNotNull() & (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    fault = F.raise_error(F.concat(F.lit("no pairs of boxes in "), F.col("file"))).cast("array<array<long>>")
    return rows.select("file", F.when(fits, F.col("pairs")).otherwise(fault).alias("pairs"))


def with_boxes(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds a_box and b_box, null without, by file stem and place in the file."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    own = pairs.select(name("file").alias("_stem"), F.posexplode("pairs").alias("query_index", "_pair"))
    rows = queries.withColumn("_stem", name("file")).join(own, ["_stem", "query_index"], "left")
    return rows.withColumns({"a_box": F.col("_pair")[0], "b_box": F.col("_pair")[1]}).drop("_stem", "_pair")


def registry(spark: SparkSession, root: str, markers: dict[str, str]) -> DataFrame:
    """(source, available, files, bytes): for each source whether files below ``root`` fit its marker, a pattern of their path there.

    Only the listing is read. A source without a file is there as not available.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    below = F.substring(path, F.locate(base, path) + len(base), F.length(path))
    own = F.explode(F.array(*[F.struct(F.lit(name).alias("source"), F.lit(pattern).alias("pattern")) for name, pattern in markers.items()])).alias("m")
    found = files.select(below.alias("below"), "length", own).where(F.regexp("below", "m.pattern"))
    counts = found.groupBy("m.source").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    rows = spark.createDataFrame([(name,) for name in markers], "source string").join(counts, "source", "left")
    return rows.select("source", F.col("files").isNotNull().alias("available"), F.coalesce("files", F.lit(0).cast("long")).alias("files"), F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def listing(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(file, case, kind, bytes): files below ``path`` by their two nearest folders; hidden and excluded folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.split("path", "/")
    out = files.select(F.col("path").alias("file"), F.element_at(parts, -3).alias("case"), F.element_at(parts, -2).alias("kind"), F.col("length").alias("bytes"))
    out = out.where(~F.element_at(F.split("file", "/"), -1).startswith("."))
    return out.where(~F.coalesce(F.col("case").isin(*excluded), F.lit(False))) if excluded else out


def write_run(rows: DataFrame, meta: DataFrame, folder: str) -> None:
    """A run's rows (Parquet by run_id, JSON lines) and its one-line description; run ids and config hashes must agree."""
    faults = rows.join(meta, ["run_id", "config_hash"], "left_anti")
    if not faults.isEmpty():
        raise ValueError("rows and run description differ in run_id or config_hash")
    rows.write.mode("append").partitionBy("run_id").parquet(f"{folder}/rows")
    rows.write.mode("append").json(f"{folder}/rows_json")
    meta.write.mode("append").json(f"{folder}/meta")


def read_run(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/rows")
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def positional_join(left: DataFrame, right: DataFrame, group: str, order_left: str, order_right: str) -> DataFrame:
    """Joins the n-th row of a group to the n-th of the other side; ``left`` keeps rows without a partner."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order_left)))
    b = right.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order_right)))
    return a.join(b, [group, "_i"], "left").drop("_i")
