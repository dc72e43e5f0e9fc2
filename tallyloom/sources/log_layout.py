"""The attempt log on disk: folders of days, files of key ranges, and a table of what each file holds.

Reads choose their files by that table before any is opened, and counts by day come from it alone. A day is written again as a whole
or added to; a large day is cut into files by ranges of the key, so a hot key is several files of one day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file at most.
FILE_ROWS = 1 << 20


@dataclass
class LogLayout:
    """A log below `root`, by the day of `at` and ranges of `key`."""

    spark: SparkSession
    root: str
    key: str
    at: str
    file_rows: int = FILE_ROWS

    def add(self, rows: DataFrame) -> LogLayout:
        """Writes rows beside those at hand, and what their files hold."""
        name = f"{self.root}/rows/part={len(self._parts())}"
        dated = rows.withColumn("day", F.to_date(self.at))
        ranged = dated.repartitionByRange("day", self.key, self.at).sortWithinPartitions("day", self.key, self.at)
        ranged.write.option("maxRecordsPerFile", self.file_rows).partitionBy("day").parquet(name)
        written = self.spark.read.option("basePath", name).parquet(name).select(F.input_file_name().alias("file"), F.col("day").cast("date").alias("day"), self.key, self.at)
        held = written.groupBy("file", "day").agg(F.count("*").alias("rows"), F.min(self.key).alias("least"), F.max(self.key).alias("most"), F.min(self.at).alias("first"), F.max(self.at).alias("last"))
        held.write.mode("append").parquet(f"{self.root}/files")
        return self

    def _parts(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rows")  # noqa: SLF001  names of folders only
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def files(self, first_day: str | None = None, last_day: str | None = None, least: object = None, most: object = None) -> DataFrame:
        """(file, day, rows, least, most, first, last) of the files that can hold rows of these days and keys, both ends included."""
        held = self.spark.read.parquet(f"{self.root}/files")
        tests = [(first_day, lambda v: F.col("day") >= F.lit(v).cast("date")), (last_day, lambda v: F.col("day") <= F.lit(v).cast("date")), (least, lambda v: F.col("most") >= v), (most, lambda v: F.col("least") <= v)]
        for value, test in tests:
            if value is not None:
                held = held.where(test(value))
        return held

    def read(self, first_day: str | None = None, last_day: str | None = None, least: object = None, most: object = None) -> DataFrame:
        """Rows of these days and keys; only files that can hold some are opened. Rows without a time belong to no day, so a limit of days leaves them out."""
        names = [r["file"] for r in self.files(first_day, last_day, least, most).select("file").collect()]
        part = self.spark.read.parquet(f"{self.root}/rows/part=0") if not names else self.spark.read.option("basePath", f"{self.root}/rows").parquet(*names)
        rows = part.drop("part", "day") if names else part.drop("day").limit(0)
        if least is not None:
            rows = rows.where(F.col(self.key) >= least)
        return rows if most is None else rows.where(F.col(self.key) <= most)

    def counts(self, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """(day, rows) from the table of files; the log is not opened."""
        return self.files(first_day, last_day).groupBy("day").agg(F.sum("rows").alias("rows"))
