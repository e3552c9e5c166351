"""Files as DataFrames: candidates and summaries in JSON, metadata in CSV, documents and images as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.schemas import PAGE_INSIGHTS, PAGES_EXTRACTED

CANDIDATES = "_graph_candidates.json"


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, length, content) of files in the order of their paths; ``pattern`` may hold alternatives as ``*.{HEIC,heic}``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).orderBy("path")


def distinct_paths(paths: DataFrame, path: str = "path", seq: str = "seq") -> DataFrame:
    """The first row of each path, in the given order."""
    w = Window.partitionBy(path).orderBy(seq)
    return paths.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n").orderBy(seq)


def first_files(files: DataFrame, n: int | None, path: str = "path") -> DataFrame:
    ordered = files.orderBy(path)
    return ordered if n is None else ordered.limit(n)


def not_done(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Files without an output yet."""
    return files.join(done.select(key), key, "left_anti")


def payload(content: Column) -> Column:
    """Base64 in one line; Spark breaks it after 76 characters unless a setting says otherwise."""
    return F.translate(F.base64(content), "\r\n", "")


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All candidate files of a folder, a row per page, with the document's name from the file's. Errors if there is none."""
    raw = spark.read.schema(PAGES_EXTRACTED).option("multiLine", True).option("pathGlobFilter", "*" + CANDIDATES).json(folder)
    return raw.withColumn("doc", F.coalesce("doc", F.regexp_replace(F.col("_metadata.file_name"), CANDIDATES.replace(".", r"\.") + "$", "")))


def doc_of(file_name: Column) -> Column:
    return F.regexp_replace(file_name, CANDIDATES.replace(".", r"\.") + "$", "")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """A summary file as (kind, key, count), or None if there is none."""
    if not exists(spark, path):
        return None
    raw = spark.read.schema("node_type_counts map<string,long>, edge_type_counts map<string,long>").option("multiLine", True).json(path)
    parts = [raw.select(F.lit(kind).alias("kind"), F.explode(column).alias("key", "count")) for kind, column in (("node", "node_type_counts"), ("edge", "edge_type_counts"))]
    return parts[0].unionByName(parts[1])


def id_column(columns: list[str]) -> str | None:
    """The first column whose name, without case and spaces aside, has both "contract" and "id"."""
    return next((c for c in columns if "contract" in c.lower() and "id" in c.lower()), None)


def read_metadata(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The metadata table, all strings, null as empty, one row per id: ``contract_id`` and the file's columns."""
    return with_contract_id(spark.read.csv(path, header=True, inferSchema=False), key)


def with_contract_id(raw: DataFrame, key: str | None = None) -> DataFrame:
    key = key or id_column(raw.columns)
    if key is None:
        raise ValueError("no column holds the contract's id")
    text = raw.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in raw.columns))
    first = F.min(F.struct(*(F.col(f"`{c}`") for c in text.columns)))
    return text.groupBy(F.col(f"`{key}`").alias("contract_id")).agg(first.alias("__r")).select("contract_id", "__r.*")


def read_insights(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PAGE_INSIGHTS).option("multiLine", True).json(folder).orderBy("_source_file")
