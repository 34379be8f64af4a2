"""Reading inputs: star-schema tables, time windows, wish lists of columns, junk before headers, chunked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def time_window(df: DataFrame, start: str, end: str, candidates: tuple[str, ...] = ("call_begin_time_utc", "call_date")) -> DataFrame:
    """Rows with start <= time < end, by the first candidate column that exists."""
    at = next((c for c in candidates if c in df.columns), None)
    if at is None:
        raise ValueError(f"none of {candidates} exists")
    return df.where((F.col(at) >= F.lit(start).cast(df.schema[at].dataType)) & (F.col(at) < F.lit(end).cast(df.schema[at].dataType)))


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in order (S3)."""
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError("no wanted column exists")
    return df.select(*found)


def coalesce_existing(df: DataFrame, names: list[str]) -> Column:
    """Coalesce over the columns that exist, null if none does."""
    found = [F.col(c) for c in names if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


class DelimitedFiles(DataSource):
    """Delimited text of many files, each with its own lines before its own header.

    Options: columns (the names to give back, by commas; a file's others are left out), least (how many of them a header line must hold at least, 2), sep,
    and the files' paths in path-1, path-2 and so on. A file is a partition, read as a stream of records in the shape that csv has: quoted fields may hold
    separators, quotes and line breaks. Names compare without case, spaces and punctuation; of names that repeat in a header the first counts, and a
    column that a file lacks is null. Rows without any value are left out. A file without a header is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "delimited_files"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema):
        return DelimitedReader(self.options)


class DelimitedReader(DataSourceReader):
    def __init__(self, options):
        self.columns, self.sep, self.least = options["columns"].split(","), options.get("sep", ","), int(options.get("least", "2"))
        self.paths = [options[f"path-{k}"] for k in range(1, int(options["files"]) + 1)]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import csv
        import io

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.value)
        with store.open_input_stream(path) as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="") as text:
            wanted, place = [plain_name(c) for c in self.columns], None
            for line in text:  # what stands before the header needn't be csv
                names = [plain_name(c) for c in next(csv.reader([line], delimiter=self.sep), [])]
                if len(set(names) & set(wanted)) >= self.least:
                    place = [names.index(c) if c in names else None for c in wanted]
                    break
            if place is None:
                raise ValueError(f"{partition.value}: no header line with {self.least} of {self.columns}")
            for row in csv.reader(text, delimiter=self.sep):
                values = tuple(row[k] if k is not None and k < len(row) and row[k] != "" else None for k in place)
                if any(v is not None for v in values):
                    yield values


def plain_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def read_delimited(spark: SparkSession, path: str, expected: list[str], sep: str = ",", least: int = 2) -> DataFrame:
    """The expected columns, all strings, of every file below path, whatever stands before each file's header and in which order that has them."""
    spark.dataSource.register(DelimitedFiles)
    files = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").orderBy("path").collect()]  # names only
    return spark.read.format("delimited_files").options(columns=",".join(expected), sep=sep, least=least, files=len(files), **{f"path-{k}": f for k, f in enumerate(files, 1)}).load()


def split_chunks(df: DataFrame, key: str, text: str, size: int = 4000) -> DataFrame:
    """key, chunk_no (from 1) and chunk of at most size characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return df.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(text), (i - 1) * size + 1, F.lit(size)))).alias("p", "chunk")).select(key, (F.col("p") + 1).alias("chunk_no"), "chunk")


def join_chunks(df: DataFrame, key: str) -> DataFrame:
    """Whole texts from (key, chunk_no, chunk); a document's chunks are the group."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "").alias("text"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
