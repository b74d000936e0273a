"""Files as tables: whole texts, bytes, CSV, JSON, listings; and what a driver does with paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value per file; a file that is none gives a row of nulls."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, delimiter: str = ",", quotechar: str = '"') -> DataFrame:
    """CSV with doubled quotes and line breaks in quoted fields; without a schema all is text."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.csv(path, header=header, sep=delimiter, quote=quotechar, escape=quotechar, multiLine=True, inferSchema=False)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("emptyValue", "").csv(path, header=header, escape='"')


def write_text(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").text(path)


def listing(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, size, modified) of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, digest) snapshot of a tree."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.sha2("content", 256).alias("digest"))


def collateral(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two snapshots: changed, created or removed."""
    b, a = before.withColumnRenamed("digest", "b"), after.withColumnRenamed("digest", "a")
    change = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "removed").otherwise("changed")
    return b.join(a, "path", "full").where("not (a <=> b)").select("path", change.alias("change"))


class FileSystem:
    """Driver-side file operations on any Hadoop file system."""

    def __init__(self, spark: SparkSession) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._util = spark._jvm.org.apache.hadoop.fs.FileUtil

    def _at(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def isfile(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def isdir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def getsize(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def getmtime(self, path: str) -> float:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def listdir(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    def makedirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        """A file; folders are for rmtree."""
        if not self.isfile(path):
            raise FileNotFoundError(path)
        fs, p = self._at(path)
        fs.delete(p, False)

    def rmdir(self, path: str) -> None:
        if self.listdir(path):
            raise OSError(f"not empty: {path}")
        fs, p = self._at(path)
        fs.delete(p, False)

    def rmtree(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def copy(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        other, q = self._at(new)
        self._util.copy(fs, p, other, q, False, self._conf)
