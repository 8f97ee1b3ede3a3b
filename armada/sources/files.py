"""Files of given names, written by executors and put in place by renaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.functions.exprs import file_path, replaced_text
from armada.operators.edit import rewrite_prompts


def file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_in_place(spark: SparkSession, staged: str, root: str) -> None:
    """Rename what executors wrote below staged, one file in each folder name=<hexadecimal path>, to its path below root."""
    path, fs = file_system(spark, root)
    # a local file that is edited later must not fail a checksum that was written beside it
    local = fs.getUri().getScheme() == "file"
    for folder in fs.listStatus(path(staged)) if fs.exists(path(staged)) else []:
        if not folder.isDirectory():
            continue
        target = path(f"{root}/{bytes.fromhex(folder.getPath().getName().removeprefix('name=')).decode()}")
        parts = [p.getPath() for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{len(parts)} files want to be {target}")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        fs.rename(parts[0], target)
        if local:
            spark.sparkContext._jvm.java.io.File(target.getParent().toUri().getPath(), f".{target.getName()}.crc").delete()
    fs.delete(path(staged), True)


def write_files(files: DataFrame, root: str, order: list[Column | str] | None = None) -> None:
    """Write files (path below root, text) under exactly these names; what is there already is replaced.

    Every text is written by an executor into a staging folder beside its place, one file each and none besides; then the
    driver renames them, one by one, so that a file is there whole or not at all: many small texts go better into few files.
    Of rows with the same path all texts are written, in the order given (columns of files), else in none.  Texts end with a
    newline.
    """
    root = root.rstrip("/")
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    rows = files.withColumns({"name": F.hex("path"), "text": F.regexp_replace("text", "\n\\z", "")})
    rows.repartition("name").sortWithinPartitions("name", *(order or [])).select("name", "text").write.option("maxRecordsPerFile", 0).partitionBy("name").text(staged)
    put_in_place(files.sparkSession, staged, root)


def rewrite_tables(spark: SparkSession, source: str, target: str, columns: dict[str, Column]) -> None:
    """The Parquet files below source with these columns computed anew, under the same names below target (which may be
    source): same columns in the same order and of the same types, same rows in the same order in each file.

    A file is written by one executor and renamed into its place, so a reader sees the old or the new one.  The files should
    have one schema: a column that a file lacks is there as nulls afterwards.
    """
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option("pathGlobFilter", "*.parquet").parquet(source)
    _, fs = file_system(spark, source)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = fs.makeQualified(path(source)).toUri().getPath().rstrip("/")
    if fs.getFileStatus(path(source)).isFile():
        base, target = base.rsplit("/", 1)[0], target.rstrip("/").rsplit("/", 1)[0]
    # what comes after the folder's own path, whatever stands before it
    inside = F.substring_index(file_path(F.col("_metadata.file_path")), f"{base}/", -1)
    kinds = {f.name: f.dataType for f in df.schema}
    # a condition that always holds and isn't known to: else Spark would write a column as required where it sees no nulls
    loose = lambda x: F.when(F.col("_metadata.row_index") >= 0, x)
    rows = df.select(*[(loose(columns[c].cast(kind)) if c in columns else F.col(f"`{c}`")).alias(c) for c, kind in kinds.items()], F.hex(inside).alias("name"), F.col("_metadata.row_index").alias("_row"))
    staged = f"{target.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    rows.repartition("name").sortWithinPartitions("name", "_row").drop("_row").write.option("maxRecordsPerFile", 0).partitionBy("name").parquet(staged)
    put_in_place(spark, staged, target.rstrip("/"))


def set_prompts(spark: SparkSession, source: str, target: str, replacements: dict[str, str]) -> int:
    """Replace task texts in the metadata of a dataset: in meta/tasks.parquet and in the lists of tasks of its episodes, where a
    missing list becomes an empty one.  Exact matches count.  Returns how many tasks changed; a dataset without tasks.parquet
    is an error."""
    path, fs = file_system(spark, source)
    if not fs.exists(path(f"{source}/meta/tasks.parquet")):
        raise FileNotFoundError(f"{source}/meta/tasks.parquet")
    changed = rewrite_prompts(spark.read.parquet(f"{source}/meta/tasks.parquet"), replacements).where("changed").count()
    if not {k: v for k, v in replacements.items() if v and v != k}:
        return 0
    rewrite_tables(spark, f"{source}/meta/tasks.parquet", f"{target}/meta/tasks.parquet", {"task": replaced_text(F.col("task"), replacements)})
    if fs.exists(path(f"{source}/meta/episodes")):
        lists = F.transform(F.coalesce("tasks", F.array().cast("array<string>")), lambda t: replaced_text(t, replacements))
        rewrite_tables(spark, f"{source}/meta/episodes", f"{target}/meta/episodes", {"tasks": lists})
    return changed
