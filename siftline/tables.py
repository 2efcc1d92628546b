"""Tables that a job writes to cut a long lineage: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a side of a few numbers or short names may be broadcast (about 16 MB); past it the join shuffles.
BROADCAST_ROWS = 500_000


#: Temporary folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A local session that names none, as in tests, gets a temporary folder; on a cluster, whose
    machines wouldn't share it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _OWN.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="siftline-")
        _OWN[context.applicationId] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"


#: How tables of rows of about a megabyte are written: sizes are looked at for each row, not for each hundredth, and a row group ends at a megabyte
#: of compressed text. A reader's batch ends with its row group, so it holds some such rows, not thousands.
WIDE_ROWS = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str, wide: bool = False, dictionary: bool = False) -> DataFrame:
    """df written as Parquet and read again; tightly compressed, as such tables take most of a job's disk. Rows that may be of a megabyte or more are wide;
    with dictionary, those of long lists whose values repeat."""
    path = new_path(df.sparkSession, name)
    df.write.options(compression="zstd", **(WIDE_ROWS | {"parquet.enable.dictionary": str(dictionary).lower()} if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, units: int, each: int, *keys: str) -> DataFrame:
    """df dealt by keys over as many partitions as hold about `each` of `units`, or the session's number if that is more: so a task's share doesn't
    grow with the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units // each)), *keys)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows, else with one for a merge join: by their files' size alone, tables of millions
    of well compressed numbers seem small enough to pass through the driver."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")
