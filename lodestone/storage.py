"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new one where a local session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, and bytes of their values as text, up to which a side of a join is broadcast.
MOST_BROADCAST, MOST_BROADCAST_BYTES = 50_000, 32 << 20


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if a count finds at most `most` rows and `most_bytes` bytes; else df as it is, for Spark to join by a shuffle."""
    size = F.octet_length(F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    n, total = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= most_bytes else df
