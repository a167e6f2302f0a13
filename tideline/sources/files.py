"""Files: bytes, chunks, lines, listings, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_chunks(spark: SparkSession, path: str, size: int = 32_768) -> DataFrame:
    """(path, at, chunk) of binary files; a file is one row before it is cut."""
    whole = spark.read.format("binaryFile").load(path)
    ats = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    return whole.filter("length > 0").select("path", "content", F.explode(ats).alias("at")).select("path", "at", F.substring("content", (F.col("at") + 1).cast("int"), F.lit(size)).alias("chunk"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; large files are split between tasks."""
    return spark.read.text(path)


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length and modification time, without the contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")


def write_lines(df: DataFrame, column: str, path: str, append: bool = False) -> None:
    df.select(column).write.mode("append" if append else "errorifexists").text(path)


def read_range(spark: SparkSession, path: str, start: int, end: int, size: int = 32_768) -> DataFrame:
    """(path, at, chunk) of the bytes from start to end (inclusive) of each file."""
    whole = spark.read.format("binaryFile").load(path)
    last = F.least(F.col("length") - 1, F.lit(end).cast("long"))
    ats = F.sequence(F.lit(start).cast("long"), last, F.lit(size).cast("long"))
    cut = F.least(F.lit(size).cast("long"), F.col("last") - F.col("at") + 1).cast("int")
    return whole.withColumn("last", last).filter(F.col("last") >= start).select("path", "content", "last", F.explode(ats).alias("at")).select("path", "at", F.substring("content", (F.col("at") + 1).cast("int"), cut).alias("chunk"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, byte) of binary files."""
    chunks = read_chunks(spark, path)
    places = F.sequence(F.lit(0), F.octet_length("chunk") - 1)
    digit = F.conv(F.hex(F.substring("chunk", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    return chunks.select("path", "at", "chunk", F.explode(places).alias("i")).select("path", (F.col("at") + F.col("i")).alias("at"), digit.alias("byte"))


def read_records(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Records of text files that each end with a separator; large files are split between tasks."""
    return spark.read.option("lineSep", end).text(path)


def list_directory(spark: SparkSession, path: str, recursive: bool = True, only: str | None = None, ignore_missing: bool = False, follow_links: bool = True) -> DataFrame:
    """(path, name, is_dir, length, modified) of a directory's entries, by the driver through Hadoop's file systems.

    only: "files" or "dirs".  ignore_missing: no rows for a path that is not there.
    Links are followed by Hadoop's local file system; follow_links = False leaves them out.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    rows: list[tuple] = []
    if ignore_missing and not fs.exists(top):
        return spark.createDataFrame([], "path string, name string, is_dir boolean, length long, modified timestamp")
    todo = [top]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isSymlink() and not follow_links:
                continue
            p = s.getPath()
            if s.isDirectory() and recursive:
                todo.append(p)
            if only is None or (only == "dirs") == s.isDirectory():
                rows.append((p.toString(), p.getName(), s.isDirectory(), s.getLen(), s.getModificationTime()))
    out = spark.createDataFrame(rows, "path string, name string, is_dir boolean, length long, ms long")
    return out.select("path", "name", "is_dir", "length", F.timestamp_millis("ms").alias("modified"))


def watch(spark: SparkSession, path: str) -> DataFrame:
    """An unbounded stream of the files that come into a directory: path, length, modification time and content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """An unbounded stream of the lines that a server sends."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def write_bytes(df: DataFrame, chunk: str, order: list[str], path: str, append: bool = False) -> int:
    """Chunks (binary) in order, one after another in one file; returns the bytes written.

    One file is one writer: rows pass through the driver a partition at a time.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out, n = fs.append(target) if append and fs.exists(target) else fs.create(target, not append), 0
    try:
        for r in df.orderBy(*order).select(chunk).toLocalIterator():
            out.write(bytearray(r[0]))
            n += len(r[0])
    finally:
        out.close()
    return n


def write_console(stream: DataFrame, mode: str = "append"):
    """Prints a stream's rows; returns the running query."""
    return stream.writeStream.format("console").outputMode(mode).start()
