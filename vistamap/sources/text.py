"""Whitespace-separated text tables, and the tables that explorers and free-energy programs write.

A point is a row of numbers; ids are positions: the file's order, then the byte order of lines within it, which Spark's text reader keeps as file name and row
index. Comment lines (#) and blank lines are skipped; a row with too few numbers is refused by name, not dropped."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, and at: the line's place among all lines of its split; ids follow from both by `numbered`."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with id 0, 1, ... in order: ranks within splits, and the counts of the splits before them. The list of splits is
    small: one row for each of the files' blocks."""
    size = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = size.select("file", "block", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return rows.join(F.broadcast(before), ["file", "block"]).withColumn("id", (rank + F.col("before")).cast("long")).drop("file", "block", "at", "before")


def fields(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")


def numbers(value: Column) -> Column:
    return F.transform(fields(value), lambda x: F.regexp_replace(x, "[dD]", "e").cast("double"))


def data_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return lines(spark, path).where(~F.ltrim("value").startswith(comment) & (F.trim("value") != ""))


def read_points(spark: SparkSession, path: str, dimensions: int, weighted: bool = False, id: str = "id") -> DataFrame:
    """id, x, w. The weight is the number after the coordinates; 1 without one."""
    rows = numbered(data_lines(spark, path)).select("id", numbers(F.col("value")).alias("v"))
    need = dimensions + weighted
    short = F.raise_error(F.concat(F.lit(f"fewer than {need} numbers in row "), F.col("id").cast("string")))
    v = F.when(F.size("v") >= need, F.col("v")).otherwise(short.cast("array<double>"))
    rows = rows.withColumn("v", v)
    return rows.select(F.col("id").alias(id), F.slice("v", 1, dimensions).alias("x"), (F.element_at("v", dimensions + 1) if weighted else F.lit(1.0)).alias("w"))


def read_landmarks(spark: SparkSession, high: str, low: str, dimensions: int, low_dimensions: int = 2, weighted: bool = False) -> DataFrame:
    """id, x, y, w from a file of points and a file of their layout, joined by position; different lengths are refused."""
    a, b = read_points(spark, high, dimensions, weighted), read_points(spark, low, low_dimensions)
    if a.count() != b.count():
        raise ValueError("points and layout have different numbers of rows")
    return a.join(b.select("id", F.col("x").alias("y")), "id").select("id", "x", "y", "w")


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """i, j, d of a square matrix of distances."""
    rows = numbered(data_lines(spark, path)).select(F.col("id").alias("i"), F.posexplode(numbers(F.col("value"))).alias("j", "d"))
    return rows.select("i", F.col("j").cast("long").alias("j"), "d")


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """frame and the columns named by the header ``#! FIELDS a b c``; other lines that begin with #! are skipped."""
    head = spark.read.text(path).where(F.col("value").rlike(r"^\s*#!\s+FIELDS\b")).select("value").first()
    if head is None:
        raise ValueError(f"{path}: no line of field names")
    names = head["value"].split()[2:]
    rows = numbered(lines(spark, path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))).select(F.col("id").alias("frame"), numbers(F.col("value")).alias("v"))
    return rows.select("frame", *(F.element_at("v", k + 1).alias(n) for k, n in enumerate(names)))


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    """x, z or x, y, z by the number of fields; several files (name, name.1, ...) give the column frame as well."""
    rows = data_lines(spark, path).select("file", numbers(F.col("value")).alias("v"))
    first = rows.select(F.size("v").alias("n")).first()
    names = ["x", "y", "z"] if first and first["n"] > 2 else ["x", "z"]
    number = F.coalesce(F.nullif(F.regexp_extract("file", r"\.(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return rows.select(number.alias("frame"), *(F.element_at("v", k + 1).alias(n) for k, n in enumerate(names)))


def count_surfaces(spark: SparkSession, path: str) -> int:
    return lines(spark, path).select("file").distinct().count()


def read_layout(spark: SparkSession, path: str, points: int) -> DataFrame:
    """id, y: the first two columns of a program's output; another number of rows than `points` is refused."""
    rows = read_points(spark, path, 2).select("id", F.col("x").alias("y"))
    if rows.count() != points:
        raise ValueError(f"{path}: not {points} rows")
    return rows


def split_floats(value: Column, separator: str = ",") -> Column:
    return F.transform(F.split(value, re.escape(separator)), lambda x: F.trim(x).cast("double"))


def after_label(rows: DataFrame, label: str) -> DataFrame:
    """Numbered lines (id, value) after the first that holds a label."""
    at = rows.where(F.instr("value", label) > 0).agg(F.min("id").alias("at"))
    return rows.crossJoin(F.broadcast(at)).where(F.col("id") > F.col("at")).drop("at")


def scientific(value: Column, digits: int = 12) -> Column:
    """A number as C's printf writes it: the decimal nearest to the double's exact value, halves to even. Java's formats round the
    shortest decimal that reads back, halves up."""
    show = f"%.{digits}e".__mod__

    def run(values: pa.Array) -> pa.Array:
        return pa.array(["null" if v is None else show(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(value.cast("double"))


def scientific_all(values: Column, digits: int = 12) -> Column:
    """Each number of an array likewise."""
    show = f"%.{digits}e".__mod__

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if x is None else ["null" if v is None else show(v) for v in x] for x in rows.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(values.cast("array<double>"))


def layout_lines(layout: DataFrame, error: bool = False, digits: int = 12) -> DataFrame:
    """value: coordinates (and error) of a row of layout (id, y, [error]), in scientific notation."""
    v = F.array_join(scientific_all(F.col("y"), digits), " ")
    return layout.select("id", (F.concat_ws(" ", v, scientific(F.col("error"), digits)) if error else v).alias("value"))


def record_lines(layout: DataFrame, points: DataFrame, name: str = "LD") -> DataFrame:
    """value: one REMARK record a point with its weight, its layout coordinates and its own coordinates."""
    rows = layout.join(points, "id")
    args = lambda c, prefix: F.array_join(F.transform(scientific_all(F.col(c)), lambda x, k: F.concat(F.lit(prefix + "."), (k + 1).cast("string"), F.lit("="), x)), " ")
    count = F.array_join(F.transform("x", lambda x, k: F.concat(F.lit("d."), (k + 1).cast("string"))), ",")
    value = F.concat(F.lit("REMARK WEIGHT="), scientific(F.col("w")), F.lit(" "), args("y", name), F.lit("\nREMARK ARG="), count, F.lit("\nREMARK "), args("x", "d"), F.lit("\nEND"))
    return rows.select("id", value.alias("value"))


def grid_lines(grid: DataFrame, i: str, j: str, columns: list[str], digits: int = 12) -> DataFrame:
    """value: one block for each i, lines in order of j, for plotting programs."""
    line = F.concat_ws(" ", *(scientific(F.col(c), digits) for c in columns))
    return grid.select(i, j, line.alias("t")).groupBy(i).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(j, "t"))), lambda x: x["t"]), "\n").alias("value")).withColumn("value", F.concat("value", F.lit("\n")))


def write_lines(rows: DataFrame, path: str, order: str = "id", header: list[str] = ()) -> None:
    """value in order, split over files that sort by name; the header comes first."""
    if header:
        rows.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.text(f"{path}/0-header")
        rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(f"{path}/1-rows")
    else:
        rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """frame 0, atom, name, residue, chain, number, x of the ATOM and HETATM lines of a fixed-width structure file."""
    v = F.col("value")
    part = lambda a, b: F.trim(F.substring(v, a, b - a + 1))
    rows = lines(spark, path).where(v.rlike("^(ATOM|HETATM)"))
    x = F.array(*(part(a, a + 7).cast("double") for a in (31, 39, 47)))
    return rows.select(F.lit(0).cast("long").alias("frame"), part(7, 11).cast("long").alias("atom"), part(13, 16).alias("name"), part(18, 20).alias("residue"), part(22, 22).alias("chain"), part(23, 26).cast("int").alias("number"), x.alias("x"))


def rescaled(rows: DataFrame, factors: dict[str, float], dropped: list[str]) -> DataFrame:
    """Lines of an input file (value) without those that begin with a dropped keyword, and with numbers after `KEY=` or `KEY ` multiplied."""
    rows = rows.where(~F.upper(F.regexp_extract(F.ltrim("value"), r"^([^\s]+)", 1)).isin([d.upper() for d in dropped]))

    def scaled(lines):
        for key, factor in factors.items():
            pattern = re.compile(rf"\b({re.escape(key)}(?:=|\s+))([+-]?[\d.]+(?:[eE][+-]?\d+)?(?:,[+-]?[\d.]+(?:[eE][+-]?\d+)?)*)")
            lines = lines.str.replace(pattern, lambda m, f=factor: m[1] + ",".join(repr(float(x) * f) for x in m[2].split(",")), regex=True)
        return lines

    return rows.withColumn("value", F.pandas_udf(scaled, "string")("value"))
