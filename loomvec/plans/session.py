"""The session that commands use when there is none."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "loomvec") -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in this one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomvec-checkpoint-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """A folder in the shared one for what is computed once and needed only inside the ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written down; ``by`` a column, so that a read of some of its values reads only their files."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        (df.write.partitionBy(by) if by else df.write).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that counting it can't run (and bill) it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
