"""Readers: source tables, checkpoint chunks, manifests and result files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svgloom import config, schemas
from svgloom.operators import sampling


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    place, fs = _place(spark, path)
    fs.delete(place, True)


def publish(spark: SparkSession, places: dict[str, str], mark: str, text: str) -> None:
    """Rename each source folder to its target, in place of what is there, and leave a file ``mark`` in it, also where there is no source.

    A target has its mark last, so a run that is cut off leaves no marked target that lacks rows. The folders are on one store; many
    are renamed at a time, since each call waits for the store.
    """
    if not places:
        return
    path, body = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, text.encode("utf-8")
    targets = list(places.values())
    fs = path(targets[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for parent in {t.rpartition("/")[0] for t in targets}:
        fs.mkdirs(path(parent))

    def one(place: tuple[str, str]) -> None:
        source, target = (path(p) for p in place)
        fs.delete(target, True)  # what a run that was cut off left
        if fs.exists(source) and not fs.rename(source, target):
            raise OSError(f"cannot move {place[0]} to {place[1]}")
        stream = fs.create(path(f"{place[1]}/{mark}"), True)
        try:
            stream.write(body)
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        for _ in pool.map(one, places.items()):
            pass


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that is there: the usual one, else an older place."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of these exist: {', '.join(paths)}")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with its ``split`` column; one without it counts as train."""
    df = spark.read.parquet(path)
    return df if "split" in df.columns else df.withColumn("split", F.lit("train"))


def present_splits(spark: SparkSession, root: str, names=config.SPLIT_PRIORITY) -> tuple[DataFrame | None, list[str]]:
    """The union of those splits that are stored under ``root``, and the names of those that are not."""
    found = [n for n in names if exists(spark, f"{root}/{n}")]
    out = None
    for n in found:
        df = spark.read.parquet(f"{root}/{n}").withColumn("split", F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, [n for n in names if n not in found]


def sample(spark: SparkSession, where: str | DataFrame | dict[str, DataFrame], spec: config.Source, key: str, size: int | None = None, seed: int = config.SEED, streaming: bool = True) -> DataFrame:
    """The seeded sample of a source given as a stored table, a table in code, or one table for each split.

    ``streaming`` reads each split once and lazily; otherwise the table is persisted first, for a source that is slow to read and has many splits.
    """
    if isinstance(where, dict):
        df = None
        for name, part in where.items():
            part = part.withColumn("split", F.lit(name))
            df = part if df is None else df.unionByName(part)
    else:
        df = dataset(spark, where) if isinstance(where, str) else where if "split" in where.columns else where.withColumn("split", F.lit("train"))
    return sampled(df if streaming else df.persist(), spec, key, size, seed)


def sampled(df: DataFrame, spec: config.Source, key: str, size: int | None = None, seed: int = config.SEED) -> DataFrame:
    """For each split of a source a seeded sample: of the size asked for, else of the source's scan size."""
    present = {r.split for r in df.select("split").distinct().collect()}
    out = None
    for name, sizes in spec.splits.items():
        if name not in present:
            raise ValueError(f"source {spec.key} has no split {name}; available: {', '.join(sorted(present))}")
        part = sampling.hash_sample(df.where(F.col("split") == name), key, sizes.scan if size is None else size, seed)
        out = part if out is None else out.union(part)
    return out


def chunks(spark: SparkSession, root: str, dataset_key: str | None = None) -> DataFrame:
    """The checkpoint rows under ``root`` (folders chunk_N, at any depth) with chunk and source path; a missing root or one without chunks is an empty table.

    Rows of older chunks take the default caption style and ``dataset_key``.
    """
    empty = spark.createDataFrame([], schemas.CHECKPOINT).withColumn("chunk", F.lit(0).cast("long")).withColumn("path", F.lit(""))
    if not exists(spark, root):
        return empty
    found = spark.read.schema(schemas.CHECKPOINT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    place = found.select("*", F.col("_metadata.file_path").alias("path")).withColumn("chunk", F.nullif(F.regexp_extract("path", r"/chunk_(\d+)/", 1), F.lit("")).cast("long")).where("chunk is not null")
    filled = place.withColumn("caption_style", F.coalesce("caption_style", F.lit(config.DEFAULT_CAPTION_STYLE)))
    return filled.withColumn("dataset", F.coalesce("dataset", F.lit(dataset_key))) if dataset_key else filled


def below(spark: SparkSession, root: str):
    """The path of a row's file below ``root``, so that no folder above it counts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(F.expr("try_url_decode(replace(_metadata.file_path, '+', '%2B'))"), r"^[^:/]+:(//[^/]*)?", "")
    return F.when(F.startswith(plain, F.lit(full + "/")), F.substr(plain, F.lit(len(full) + 2))).otherwise(plain)


def of_sources(df: DataFrame, keys, column: str = "dataset") -> DataFrame:
    """The rows of these sources: a membership test that reaches the scan."""
    return df.where(F.col(column).isin(*keys))


def repair_chunks(spark: SparkSession, *roots: str) -> DataFrame:
    """Repair rows of all chunks under these roots with their path below the root; roots that are not there are skipped."""
    out = spark.createDataFrame([], schemas.REPAIR).withColumn("path", F.lit(""))
    for root in roots:
        if exists(spark, root):
            found = spark.read.schema(schemas.REPAIR).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
            out = out.unionByName(found.select("*", below(spark, root).alias("path")).where(F.col("path").rlike("(^|/)chunk_[^/]*/")))
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    entry = "array<struct<evaluation_index:long,filename:string>>"
    return spark.read.schema(f"tasks struct<text:{entry},image:{entry},repair:{entry}>").option("multiLine", True).json(path)


def examples(spark: SparkSession, manifest_path: str, root: str, task: str = "image") -> DataFrame:
    """The manifest's examples with the paths of their target files, ``root/NNNN/target.png`` and ``.svg``; one that lacks a file is an error."""
    from svgloom.operators import evaluation

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "target.*").load(root).select("path")
    number = F.regexp_extract("path", r"/(\d+)/target\.(?:png|svg)$", 1)
    found = listed.where(number != "").groupBy(number.cast("long").alias("evaluation_index")).agg(F.max(F.when(F.endswith("path", F.lit(".png")), F.col("path"))).alias("image_path"), F.max(F.when(F.endswith("path", F.lit(".svg")), F.col("path"))).alias("svg_path"))
    rows = evaluation.manifest_examples(manifest(spark, manifest_path), task).join(found, "evaluation_index", "left")
    lacking = F.concat(F.lit("target files are missing for evaluation index "), F.col("evaluation_index").cast("string"))
    return rows.where((F.col("image_path").isNotNull() & F.col("svg_path").isNotNull()) | F.raise_error(lacking).cast("boolean")).select(*schemas.EXAMPLE.names)


def results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result files, one for each example; output_index comes from the folder's number."""
    extra = schemas.T.StructType([*schemas.RESULTS.fields, schemas.T.StructField("latency_seconds", schemas.T.DoubleType()), schemas.T.StructField("request_error", schemas.T.StringType())])
    df = spark.read.schema(extra).option("multiLine", True).json(pattern)
    return df.withColumn("output_index", F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)/[^/]*$", 1), F.lit("")).cast("long"))
