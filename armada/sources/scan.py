"""Frame tables of a dataset folder: what can be read, and an issue for each file that can't."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from armada.functions.exprs import file_path, flat_vector, last_number
from armada.sources.scratch import written

#: The columns of a frame table that hold vectors.
VECTORS = ("observation.state", "state", "action")
#: Where a dataset's frames are unless its info says otherwise (fixed value).
DATA_PATH = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
ISSUES = "severity string, rule string, message string, path string"


def data_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every Parquet file below root/data; names are listed, no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        files = reader.load(f"{root}/data").select("path")
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], "path string")
    # Spark knows of files without a byte but doesn't list them; their names are fetched only if there are any
    names = files._jdf.inputFiles()
    if len(names) == files.count():
        return files
    every = spark.createDataFrame([(n,) for n in names], "path string").select(file_path(F.col("path")).alias("path"))
    return files.select(plain("path").alias("path")).unionByName(every).distinct()


def plain(path: str) -> Column:
    """Local paths are written with one slash or three after the scheme."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def stem(path: Column) -> Column:
    """The name of a frame file without its ending; of a file that Spark wrote into a folder of that name, the folder's."""
    name = F.regexp_extract(path, r"([^/]+)\.parquet$", 1)
    folder = F.regexp_extract(path, r"([^/]+)\.parquet/[^/]+$", 1)
    return F.coalesce(F.nullif(folder, F.lit("")), name)


def depth(kind: DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, ArrayType) else 0


def why_unreadable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and message of those files that can't be opened.  Their content is read by executors."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    pq.ParquetFile(io.BytesIO(content.as_py() or b""))
                except Exception as e:  # whatever is wrong with the file is what the issue says
                    out.append({"path": path, "message": str(e)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("message", pa.string())]))

    if not paths:
        return spark.createDataFrame([], "path string, message string")
    opened = spark.read.format("binaryFile").load(paths)
    none = opened.select(plain("path").alias("path"))  # files without a byte aren't opened at all
    asked = spark.createDataFrame([(p,) for p in paths], "path string").select(plain("path").alias("path"))
    void = asked.join(none, "path", "left_anti").withColumn("message", F.lit("the file is empty"))
    return opened.select("path", "content").mapInArrow(probe, "path string, message string").unionByName(void)


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(frames, issues) of a dataset folder.

    frames: file, episode, frame, and each vector column that any file has, as array<double> (nested ones flattened, nulls inside
    as NaN).  A file without episode_index has the last number of its name as episode; rows without any episode are left out.
    A frame without frame_index has its place in the file.  Files without a vector column, and whole files that can't be read to
    their end, are left out.  issues: one warning for each of the latter, with what is wrong.  A folder without any Parquet file
    is an error; columns that have different types in two files are an error too.

    A first pass counts, file by file, the rows that the footers promise and those that can be read, and which columns hold
    anything; of that table only the paths of broken and empty files reach the driver, as does Spark's own list of files.
    """
    listed = data_files(spark, root)
    if listed.isEmpty():
        raise ValueError(f"no Parquet file below {root}/data")
    # of that many files each may be broken, whatever the session's settings say
    reader = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet")
    try:
        df = reader.parquet(f"{root}/data")
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        df = spark.createDataFrame([], "episode_index long").withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("row_index")))
    kinds = {c: df.schema[c].dataType for c in VECTORS if c in df.columns}
    file = file_path(F.col("_metadata.file_path"))
    held = lambda c: F.count(F.col(f"`{c}`")) if c in df.columns else F.lit(0).cast("long")
    promised = df.groupBy(file.alias("path")).agg(F.count(F.lit(1)).alias("promised"))
    read = df.groupBy(file.alias("path")).agg(F.count(F.lit(1)).alias("read"), held("episode_index").alias("episodes"), held("frame_index").alias("frames"), sum((held(c) for c in kinds), F.lit(0).cast("long")).alias("vectors"))
    files = listed.select(plain("path").alias("path"), F.col("path").alias("listed")).join(promised, "path", "left").join(read, "path", "left")
    files = written(files, "files")
    silent = [r["listed"] for r in files.where("promised is null").select("listed").collect()]
    broken = why_unreadable(spark, silent).unionByName(files.where("promised is not null and (read is null or read < promised)").select(F.col("listed").alias("path"), F.format_string("only %d of %d rows can be read", F.coalesce("read", F.lit(0)), F.col("promised")).alias("message")))
    issues = broken.select(F.lit("warn").alias("severity"), F.lit("parquet_read").alias("rule"), "message", "path")

    good = files.where("read = promised and vectors > 0").select(F.col("path").alias("_path"), (F.col("episodes") > 0).alias("_numbered"))
    number = F.col("episode_index").cast("long") if "episode_index" in df.columns else F.lit(None).cast("long")
    place = F.coalesce(F.col("frame_index").cast("long"), F.col("_metadata.row_index")) if "frame_index" in df.columns else F.col("_metadata.row_index")
    vectors = [flat_vector(F.col(f"`{c}`"), depth(kind)).alias(c) for c, kind in kinds.items()]
    rows = df.select(file.alias("file"), number.alias("_number"), place.alias("frame"), *vectors)
    rows = rows.join(good, F.col("file") == F.col("_path"))
    episode = F.when(F.col("_numbered"), F.col("_number")).otherwise(last_number(stem(F.col("file"))))
    return rows.select("file", episode.alias("episode"), "frame", *[f"`{c}`" for c in kinds]).where("episode is not null"), issues


def first_episodes(spark: SparkSession, root: str, n: int, template: str = DATA_PATH) -> tuple[list[int], list[str]]:
    """(episodes, files): the n first episodes and the files below root that hold them, so that only these are read.

    The metadata of episodes say which file an episode is in (data/chunk_index and data/file_index, by template); where they
    don't, the last number of a file's name is its episode.  n names and their files reach the driver.
    """
    named = None
    try:
        meta = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(f"{root}/meta/episodes")
        if {"episode_index", "data/chunk_index", "data/file_index"} <= set(meta.columns):
            from armada.sources.datasets import filled

            path = filled(template, {"chunk_index": F.col("`data/chunk_index`"), "file_index": F.col("`data/file_index`")})
            named = meta.select(F.col("episode_index").cast("long").alias("episode"), F.concat(F.lit(f"{root.rstrip('/')}/"), path).alias("path")).dropna()
    except AnalysisException:  # no metadata
        pass
    if named is None:
        named = data_files(spark, root).select(last_number(stem(F.col("path"))).alias("episode"), "path").where("episode is not null")
    first = named.groupBy("episode").agg(F.collect_set("path").alias("paths")).orderBy("episode").limit(n).collect()
    return [r["episode"] for r in first], sorted({p for r in first for p in r["paths"]})


def read_first_episodes(spark: SparkSession, root: str, n: int, template: str = DATA_PATH) -> DataFrame:
    """Frame tables of the n first episodes, all columns and episode; no other file is opened.  No episodes: an error."""
    episodes, files = first_episodes(spark, root, n, template)
    if not files:
        raise ValueError(f"no file below {root} belongs to an episode")
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(*files)
    own = F.col("episode_index").cast("long") if "episode_index" in df.columns else last_number(stem(file_path(F.col("_metadata.file_path"))))
    # a file holds several episodes, of which the first n are wanted
    return df.withColumn("episode", own).where(F.col("episode").between(min(episodes), max(episodes)))
