"""Tables that micro-batches write, as plain partitioned Parquet.

Layout: ``<path>/epoch=<E>/<part>=<P>/*.parquet``. A batch writes the folder of its
own epoch in overwrite mode, so a replayed batch replaces whatever a failed
attempt left there, and no plan overwrites its input. Spark's ``_SUCCESS`` file,
which it writes last, tells that the folder is whole. Readers name the
(epoch, part) folders they need, so all others stay unlisted and unread.

``EpochTable`` adds rows: its content is all epochs (records, due entries).
``BucketTable`` replaces rows: its rows are dealt by a hash of their key into a fixed
number of buckets, a batch rewrites only the buckets it changed, and the newest
version of each bucket is the content (state, match details). Superseded versions
but the last one are deleted after a commit.

Paths go through Hadoop's FileSystem, so the same code works on any storage
that the cluster names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class EpochTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, part: str):
        self.spark, self.path, self.schema, self.part = spark, path.rstrip("/"), schema, part
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _glob(self, pattern: str) -> list[str]:
        return [f.getPath().toString() for f in self._fs.globStatus(self._at(pattern)) or []]

    def done(self, epoch: int) -> bool:
        return self._fs.exists(self._at(f"epoch={epoch}/_SUCCESS"))

    def parts(self, before: int | None = None) -> list[tuple[int, int]]:
        """(epoch, part) of every folder of a whole epoch, or of those before an epoch."""
        whole = {int(p.split("epoch=")[-1].split("/")[0]) for p in self._glob("epoch=*/_SUCCESS")}
        names = [p.rsplit("/", 2)[1:] for p in self._glob(f"epoch=*/{self.part}=*")]
        pairs = [(int(e.split("=")[1]), int(p.split("=")[1])) for e, p in names]
        return sorted(x for x in pairs if x[0] in whole and (before is None or x[0] < before))

    def folders(self, parts: list[tuple[int, int]]) -> DataFrame:
        """The rows of these (epoch, part) folders, with both numbers as columns."""
        schema = f"{self.schema}, epoch int, {self.part} int"
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/epoch={e}/{self.part}={p}" for e, p in parts]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    def write(self, df: DataFrame, epoch: int) -> None:
        """Write the epoch's rows; ``df`` holds the part column."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        (df.select(*columns, self.part).hint("rebalance", F.col(self.part))
         .write.mode("overwrite").partitionBy(self.part).parquet(f"{self.path}/epoch={epoch}"))

    def drop(self, parts: list[tuple[int, int]]) -> None:
        for e, p in parts:
            self._fs.delete(self._at(f"epoch={e}/{self.part}={p}"), True)


class BucketTable(EpochTable):
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        super().__init__(spark, f"{path.rstrip('/')}/of={buckets}", schema, "bucket")
        self.key, self.buckets = key, buckets
        others = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/of=*")
        for f in self._fs.globStatus(others) or []:
            if f.getPath().getName() != f"of={buckets}":
                raise ValueError(f"{path} has another number of buckets: {f.getPath().getName()}")

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> dict[int, list[int]]:
        """The epochs of each bucket, newest first."""
        out: dict[int, list[int]] = {}
        for e, b in reversed(self.parts(before)):
            out.setdefault(b, []).append(e)
        return out

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The newest version of these buckets (all by default), or the newest
        that was written before an epoch."""
        newest = [(es[0], b) for b, es in self.versions(before).items() if buckets is None or b in buckets]
        return self.folders(sorted(newest)).drop("epoch", "bucket")

    def write(self, df: DataFrame, epoch: int) -> None:
        super().write(df.withColumn("bucket", self.bucket()), epoch)

    def tidy(self) -> None:
        """Delete versions that two newer ones of their bucket supersede."""
        self.drop([(e, b) for b, es in self.versions().items() for e in es[2:]])


def buckets_of(df: DataFrame, bucket: Column) -> list[int]:
    """The buckets that the rows fall into: as many numbers as buckets at most."""
    return sorted(r[0] for r in df.select(bucket).distinct().collect())
