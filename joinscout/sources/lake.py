"""Tables of a lake: CSV, Parquet and JSON files, connection files, and tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import graph

CONNECTIONS = ("connections.csv", "connections_transformer.csv")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with header, quotes and backslash escapes; without a schema types are inferred."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", "\\")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By the name's ending: parquet, json, orc or csv."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path, schema=schema)
    if path.endswith(".orc"):
        return spark.read.orc(path)
    return read_csv(spark, path, schema)


def read_timed(spark: SparkSession, path: str, time: str = "time", order: bool = False) -> DataFrame:
    """A table whose time column reads as whole numbers; rows without one go."""
    df = read_table(spark, path)
    df = df.withColumn(time, F.col(time).cast("string").try_cast("double").try_cast("bigint")).na.drop(subset=[time])
    return df.orderBy(time) if order else df


def list_tables(spark: SparkSession, folder: str, ending: str = ".csv") -> dict[str, str]:
    """name: path of every file below the folder but connection files; listed by Spark, so any file system will do."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(folder).select("path")
    paths = sorted(r.path for r in names.collect())  # file names of the lake
    return {p.rsplit("/", 1)[1].removesuffix(ending): p for p in paths if p.rsplit("/", 1)[1] not in CONNECTIONS}


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a connections file, read by column name; weight is its score, or 1."""
    df = read_csv(spark, path)
    weight = F.col("score").cast("double") if "score" in df.columns else F.lit(1.0)
    bare = lambda c: F.regexp_replace(F.col(c), r"\.csv$", "")
    return df.select(bare("fk_table").alias("from_id"), bare("pk_table").alias("to_id"), F.col("fk_column").alias("from_column"), F.col("pk_column").alias("to_column"), weight.alias("weight"))


def open_lake(spark: SparkSession, folder: str, ending: str = ".csv", connections: str | None = None):
    """A lake of all tables below a folder, with the edges of its connections file."""
    from ..plans.search import Lake

    tables = {n: read_table(spark, p) for n, p in list_tables(spark, folder, ending).items()}
    return Lake(tables, read_connections(spark, connections) if connections else graph.empty(spark))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ARFF file, columns as text named by its attributes."""
    lines = spark.read.text(path).where("trim(value) <> '' and not value like '%\\%%' escape '\\\\' or value like '@%'")
    names = [r.value.split(None, 2)[1].strip("'\"") for r in lines.where("lower(value) like '@attribute%'").collect()]
    text = ", ".join(f"`{n}` string" for n in names)
    quote = F.regexp_replace("value", r"(?<![\\w])b?'((?:[^'\\\\]|\\\\.)*)'", '"$1"')  # values in single quotes may hold commas
    rows = lines.where("not value like '@%'").select(F.from_csv(quote, text, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("v"))
    return rows.select("v.*")


def wide_from_files(spark: SparkSession, folder: str, pattern: str, keys: list[str], label: str = "subcarrier", width: int | None = None) -> DataFrame:
    """Files of one number a line to one row a file: keys from the file name, and a column for each line of the longest file (null where a file has fewer).

    width: how many columns instead; a file of more lines is an error then, never cut.
    """
    rows = spark.read.text(folder, recursiveFileLookup=True, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if width is not None and longest > width:
        raise ValueError(f"a file has {longest} lines, more than {width}")
    return rows.select(*[F.regexp_extract("path", pattern, i + 1).alias(k) for i, k in enumerate(keys)], *[F.get("v", F.lit(i)).try_cast("double").alias(f"{label}_{i}") for i in range(longest if width is None else width)])
