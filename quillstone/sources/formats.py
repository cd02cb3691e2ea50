"""Readers and writers of the file formats in use; all through Spark's own readers, so any store will do."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seq import clean
from ..operators.ranking import with_ordinal

CANDIDATE = T.StructType([T.StructField("accession", T.StringType()), T.StructField("sequence", T.StringType()), T.StructField("score", T.DoubleType())])
MESSAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("role", "content", "name", "tool_call_id", "tool_calls")])
TRAJECTORY = T.StructType([T.StructField("index", T.LongType()), T.StructField("first_user", T.StringType()), T.StructField("final_dialog", T.ArrayType(MESSAGE))])
FAMILY = T.StructType([T.StructField(c, T.StringType()) for c in ("family_id", "clan_id", "clan_name", "name", "description")])


# Tables


def parquet_union(spark: SparkSession, *paths: str) -> DataFrame:
    """All rows of all paths; columns that a path lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """With a header, quoted fields of several lines and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, order: str, separator: str = ",") -> None:
    """In the order of one column; the parts' names keep it."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.option("header", True).option("sep", separator).option("escape", '"').mode("overwrite").csv(path)


def overwrite(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Replaces path even where df is read from it: written beside it first, then moved."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def append_board(row: DataFrame, path: str) -> None:
    """One more row of a leaderboard, whose columns may grow."""
    spark = row.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.read.parquet(path) if there.getFileSystem(conf).exists(there) else None
    overwrite(row if old is None else old.unionByName(row, allowMissingColumns=True), path)


# JSON


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped; a damaged line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file documents or arrays of them; no rows where nothing is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_documents(df: DataFrame, path: str) -> None:
    """Adds rows to JSON documents or arrays of them; damaged ones there are dropped, nothing there is an empty list."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df = spark.read.schema(df.schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).unionByName(df)
    # A reader of whole files takes one document a file, so each file gets one array.
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("part", F.floor(F.col("at") / 100_000).alias("block")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]), ","), F.lit("]")).alias("value"))
    overwrite(blocks.select("value"), path, "text", maxRecordsPerFile=1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """accession, sequence (clean, not empty), score."""
    return json_documents(spark, path, CANDIDATE).withColumn("sequence", clean(F.col("sequence"))).filter("sequence <> ''")


def dialogs(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories with the text of the first user turn, be first_user a text or a JSON list of messages, and the last message."""
    listed = F.from_json("first_user", T.ArrayType(MESSAGE))
    user = lambda a: F.try_element_at(F.filter(a, lambda m: m["role"] == "user"), F.lit(1))["content"]
    t = json_lines(spark, path, TRAJECTORY)
    first = F.coalesce(user(listed), F.when(~F.ltrim("first_user").startswith("["), F.col("first_user")), user(F.col("final_dialog")))
    return t.withColumns({"first_user": first, "last_message": F.try_element_at("final_dialog", F.lit(-1))["content"]})


# Lines and blocks


def _blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).filter(F.trim("value") != "")


def fasta(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """header, id (its first word), sequence in upper case without white space; records without letters are left out."""
    value = F.regexp_replace("value", "^>", "")
    header = F.trim(F.regexp_extract(value, r"^([^\n]*)", 1))
    body = clean(F.regexp_replace(value, r"^[^\n]*\n?", ""))
    # Records begin at ">" after a line feed; a file's first record keeps its own mark.
    rows = _blocks(spark, path, "\n>").select(header.alias("header"), F.regexp_extract(header, r"^(\S*)", 1).alias("id"), body.alias("sequence")).filter("sequence <> ''")
    return rows.filter(F.length("sequence") <= longest) if longest else rows


def numbered(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Rows as read with their places 0, 1, ... in the order of files and splits."""
    return with_ordinal(df.withColumn("__at", F.monotonically_increasing_id()), "__at", 1 << 33, name).drop("__at")


def sequence_lines(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line, without comments and blank lines."""
    return spark.read.text(path).filter(~F.ltrim("value").startswith("#")).select(clean(F.col("value")).alias("sequence")).filter("sequence <> ''")


def write_fasta(df: DataFrame, path: str, header: str, sequence: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def stockholm(spark: SparkSession, path: str, accession: str | None = None) -> DataFrame:
    """accession, id, alignment of each block; only those whose accession begins as given."""
    tag = lambda name: F.regexp_extract("value", rf"(?m)^#=GF {name}\s+(\S+)", 1)
    lines = F.filter(F.split("value", "\n"), lambda x: (x != "") & ~x.startswith("#"))
    rows = _blocks(spark, path, "//\n").select(tag("AC").alias("accession"), tag("ID").alias("id"), lines.alias("alignment"))
    return rows.filter(F.col("accession").startswith(accession)) if accession else rows


def prosite(spark: SparkSession, path: str) -> DataFrame:
    """ID, AC, DE, PA, CC of each entry with a pattern; lines of one tag are joined, patterns without a space and the last dot."""
    body = lambda tag: F.transform(F.filter(F.split("value", "\n"), lambda x: x.startswith(tag + "   ")), lambda x: F.trim(F.substring(x, 6, 1 << 20)))
    rows = _blocks(spark, path, "//\n").select(
        F.regexp_extract(F.array_join(body("ID"), " "), r"^([^;\s]+)", 1).alias("ID"),
        F.rtrim(F.array_join(body("AC"), ""), F.lit(";")).alias("AC"),
        F.rtrim(F.array_join(body("DE"), " "), F.lit(".")).alias("DE"),
        F.rtrim(F.array_join(body("PA"), ""), F.lit(".")).alias("PA"),
        F.array_join(body("CC"), " ").alias("CC"),
    )
    return rows.filter("PA <> ''")


def families(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with comment lines; rows of under five fields are left out, further fields ignored."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("p", parts).filter(F.size("p") >= 5)
    return rows.select(*[F.trim(F.col("p")[i]).alias(c) for i, c in enumerate(FAMILY.names)])


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A headed table of texts whose separator (tab, else the most frequent of , ;) is read off its header line."""
    head = spark.read.text(path).limit(1).collect()  # one line
    line = head[0][0].lstrip("﻿") if head else ""
    separator = "\t" if "\t" in line else max(",;", key=line.count)
    df = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    named = df.toDF(*[c.lstrip("﻿").strip().strip("'\"") for c in df.columns])
    return named.select(*[F.regexp_replace(F.trim(F.col(f"`{c}`")), "^'(.*)'$", "$1").alias(c) for c in named.columns])


def reactions(spark: SparkSession, path: str) -> DataFrame:
    """reaction_id, equation, ecs (list), n_proteins."""
    df = sniffed(spark, path)
    name = {"reaction_id": "Reaction identifier", "equation": "Equation", "ecs": "EC number", "n": "UniProt"}
    ecs = F.filter(F.transform(F.split(F.coalesce(F.col(f"`{name['ecs']}`"), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.col(f"`{name['reaction_id']}`").alias("reaction_id"), F.col(name["equation"]).alias("equation"), ecs.alias("ecs"), F.col(name["n"]).try_cast("long").alias("n_proteins"))


def pdb_confidence(spark: SparkSession, path: str) -> DataFrame:
    """file, chain, position, confidence: the mean of the temperature column over a residue's atoms."""
    v = F.col("value")
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter(v.startswith("ATOM"))
    part = lambda a, n: F.trim(F.substring(v, a, n))
    return rows.groupBy("file", part(22, 1).alias("chain"), part(23, 4).try_cast("int").alias("position")).agg(F.avg(part(61, 6).try_cast("double")).alias("confidence"))


def hmm_header(spark: SparkSession, path: str) -> DataFrame:
    """tag and value of the lines before the model itself."""
    head = F.split(F.regexp_extract("value", r"(?s)^(.*?)(?:\nHMM\s|\z)", 1), "\n")
    rows = spark.read.text(path, wholetext=True).select(F.explode(head).alias("line"))
    return rows.select(F.regexp_extract("line", r"^(\S+)\s+(.*)$", 1).alias("tag"), F.trim(F.regexp_extract("line", r"^(\S+)\s+(.*)$", 2)).alias("value")).filter("tag <> ''")


# Vector tables


def write_vectors(df: DataFrame, path: str, *partitions: str) -> None:
    """Only ids that are not yet there are added; readers prune by the partition columns."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df = df.join(spark.read.parquet(path).select("row_id", *partitions), ["row_id", *partitions], "left_anti")
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def vectors(spark: SparkSession, *paths: str, **only: list[str]) -> DataFrame:
    """Vector tables of several shards as one; `only` names partition columns (modality, subsection) and the values to read."""
    df = parquet_union(spark, *paths)
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isin(v) for c, v in only.items()], F.lit(True)))
