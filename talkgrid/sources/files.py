"""Reading texts, JSON lines, CSV labels and binary files, with errors as rows instead of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start_sec", T.DoubleType()), T.StructField("end_sec", T.DoubleType()), T.StructField("video_id", T.StringType())])
GOLD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "question", "video_id", "talk_title", "split", "question_type", "negative_scope")]
    + [T.StructField("gold_spans", T.ArrayType(SPAN)), T.StructField("expected_answer", T.StringType()), T.StructField("expected_claims", T.ArrayType(T.StringType())), T.StructField("abstention_expected", T.BooleanType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("modality", "tags")]
    + [T.StructField("verified", T.BooleanType())]
)


def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: path, text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines of a schema; a line that is not valid JSON keeps its text in ``corrupt`` and reading goes on."""
    kept = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    lines = spark.read.text(paths).filter(F.trim("value") != "").select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    parsed = lines.select("path", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    return parsed.select("path", "r.*")


def csv_labels(spark: SparkSession, path: str, ints: list[str]) -> DataFrame:
    """A CSV with a header; the named columns as integers, blank or odd values null."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.expr(f"try_cast(nullif(trim(`{c}`), '') AS int)").alias(c) if c in ints else F.col(f"`{c}`") for c in df.columns])


def json_document(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A JSON file of one document; missing required keys are an error."""
    df = spark.read.option("multiLine", True).json(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing {missing}")
    return df


def file_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SHA-256 and size of binary files, read in the executors."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, as many files as partitions."""
    df.write.mode("overwrite").json(path)


def time_grid(videos: DataFrame, video: str, duration: str, every: float) -> DataFrame:
    """Sampling times ``0, every, 2 * every, ...`` below the duration of each video."""
    last = F.ceil(F.col(duration) / every).cast("int") - 1
    return videos.filter(F.col(duration) > 0).select(video, F.explode(F.sequence(F.lit(0), last)).alias("n")).select(video, (F.col("n") * every).alias("frame_sec"))


def canonical_url(url, keep: str = "v"):
    """A URL reduced to its place and one query key, without fragment."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    value = F.regexp_extract(url, rf"[?&]{keep}=([^&#]*)", 1)
    return F.when(value != "", F.concat(base, F.lit(f"?{keep}="), value)).otherwise(base)
