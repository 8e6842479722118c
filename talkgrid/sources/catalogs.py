"""Catalogues, evidence and other small files, with all errors collected before one is raised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.sources.files import whole_texts


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs pyyaml") from e
    return yaml


def yaml_entries(spark: SparkSession, path: str, schema: T.StructType, under: str | None = None) -> DataFrame:
    """The list of mappings of a YAML file (or of its key ``under``) as rows of a schema; a catalogue is small and read on the driver.

    Times are ISO 8601 text in the schema's string columns; missing keys are null, others are dropped.
    """
    text = "\n".join(r.text for r in whole_texts(spark, path).select("text").collect())
    found = _yaml().load(text, Loader=_yaml().BaseLoader)
    rows = found.get(under) if under and isinstance(found, dict) else found
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError(f"{path}: not a list of mappings")
    flat = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, T.ArrayType) else T.StringType()) for f in schema.fields])
    df = spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], flat)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def lookup(df: DataFrame, **keys) -> dict:
    """The one row with these values; none or several are a KeyError that lists what there is."""
    rows = df
    for name, value in keys.items():
        rows = rows.filter(F.col(name) == value)
    found = rows.limit(2).collect()
    if len(found) != 1:
        known = [str(r) for r in df.select(*keys).distinct().limit(50).collect()]
        raise KeyError(f"{keys}: {len(found) or 'no'} rows; known are {known}")
    return found[0].asDict(recursive=True)


def local_candidates(df: DataFrame, component: str, required: list[str]) -> DataFrame:
    """Candidates of a component that run locally and offer all required channels; a candidate that does not is an error."""
    own = df.filter(F.col("component") == component)
    bad = own.filter((F.col("provider") != "local") | (F.size(F.array_except(F.array(*[F.lit(c) for c in required]).cast("array<string>"), "channels")) > 0)).select("id").limit(20).collect()
    if bad:
        raise ValueError(f"not local or without the channels {required}: {[r.id for r in bad]}")
    return own


EVIDENCE = T.StructType([T.StructField("visual_element", T.StringType()), T.StructField("required_any", T.ArrayType(T.StringType())), T.StructField("normalize", T.StringType())])


def numbered_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with the number of each line in its file, from 1; a line that is not JSON keeps its text in ``corrupt``.

    A file is read whole, so that its lines are counted in order.
    """
    kept = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    lines = whole_texts(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "value")).filter(F.trim("value") != "")
    parsed = lines.select("path", (F.col("n") + 1).alias("line"), F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    return parsed.select("path", "line", "r.*")


def visual_evidence(examples: DataFrame) -> DataFrame:
    """Evidence items (id, item, visual_element, required_any, normalize) of examples; an item without terms is an error."""
    items = examples.select("id", F.posexplode("visual_evidence").alias("item", "e")).select("id", "item", "e.visual_element", "e.required_any", F.coalesce("e.normalize", F.lit("lowercase_collapse_ws")).alias("normalize"))
    bad = items.filter("required_any IS NULL OR size(required_any) = 0").select("id").distinct().limit(20).collect()
    if bad:
        raise ValueError(f"evidence without terms: {sorted(r.id for r in bad)}")
    return items


def normalized(text, mode: str):
    """Text as ``exact`` or ``lowercase_collapse_ws`` compare it; any other mode is an error."""
    if mode == "exact":
        return text
    if mode == "lowercase_collapse_ws":
        return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    raise ValueError(f"unknown normalization {mode!r}")


def evidence_hits(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Per example whether every item is met by one of its terms in some text: id, passes, matched (terms joined by `` AND ``), reason.

    ``texts``: id, text.  Examples without evidence are not there (they cannot be judged).
    """
    low = lambda c: normalized(c, "lowercase_collapse_ws")
    both = items.join(texts, "id", "left")
    exact = F.filter("required_any", lambda t: F.contains(F.col("text"), t))
    loose = F.filter("required_any", lambda t: F.contains(low(F.col("text")), low(t)))
    hit = F.when(F.col("normalize") == "exact", exact).otherwise(loose)
    per = both.groupBy("id", "item").agg(F.min(F.get(hit, F.lit(0))).alias("term"), F.count("text").alias("n"))
    out = per.groupBy("id").agg(F.bool_and(F.col("term").isNotNull()).alias("passes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("item", "term")))), lambda x: x["term"]), " AND ").alias("matched"), F.max("n").alias("n"))
    return out.select("id", "passes", "matched", F.when(F.col("n") == 0, "no text").when(~F.col("passes"), "term missing").alias("reason"))


def fetch_paths(talks: DataFrame, explicit: DataFrame, root: str, id_col: str = "video_id") -> DataFrame:
    """Where the file of every talk lies: an explicit path (``id_col``, path) beats the place under ``root``."""
    return talks.join(explicit.select(id_col, F.col("path").alias("__p")), id_col, "left").withColumn("path", F.coalesce("__p", F.concat(F.lit(root.rstrip("/") + "/"), F.col(id_col), F.lit(".mp4")))).drop("__p")


def prompt_hash(spark: SparkSession, path: str) -> str:
    """The twelve first digits of the SHA-256 of a prompt file."""
    return whole_texts(spark, path).select(F.substring(F.sha2("text", 256), 1, 12).alias("h")).first().h


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pictures with their size and channels, decoded in the executors; what is no picture is left out."""
    return spark.read.format("image").option("dropInvalid", True).load(paths).select("image.origin", "image.width", "image.height", "image.nChannels")


def cached_vectors(spark: SparkSession, folder: str, keys: DataFrame, key: str, make) -> DataFrame:
    """Vectors kept in a Parquet folder, made anew by ``make(keys)`` when the folder holds other keys."""
    try:
        kept = spark.read.parquet(folder)
        stale = kept.select(key).exceptAll(keys.select(key)).limit(1).count() + keys.select(key).exceptAll(kept.select(key)).limit(1).count()
    except Exception as e:  # a folder that is not there
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stale = 1
    if stale:
        make(keys).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
