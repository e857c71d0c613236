"""Sessions, and tables staged in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "quirewise", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench. On a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and all runs on one machine (tests) a local one is
    made: on a cluster each executor would write to a disk of its own, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quirewise-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What stage() and stage_bucketed() made and nobody has removed yet: (folder, table or None) by application.
_staged: dict[str, list[tuple[str, str | None]]] = {}


def _note(spark: SparkSession, path: str, table: str | None = None) -> None:
    _staged.setdefault(spark.sparkContext.applicationId, []).append((path, table))


def _remove(spark: SparkSession, path: str, table: str | None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, after: int = 0) -> None:
    """Remove what was staged in this session, but for the first `after` tables. What still reads them fails."""
    made = _staged.get(spark.sparkContext.applicationId, [])
    for path, table in made[after:]:
        _remove(spark, path, table)
    del made[after:]


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end all that was staged inside is removed: results must be written or collected within."""
    before = len(_staged.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage is cut, and the loss of an
    executor costs nothing that was staged."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a table made by stage() that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        p = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """stage(), bucketed by key: what reads it back is already hash-partitioned by key and needs no exchange.
    One file a bucket is written, as the rows are repartitioned by the key first."""
    spark = df.sparkSession
    n = buckets or partitions(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table, format="parquet")
    _note(spark, path, table)
    return spark.table(table)


#: A table is broadcast only when counted to hold at most so many rows, and bytes of text in them.
FEW_ROWS, FEW_BYTES = 400_000, 32 << 20


def fits(df: DataFrame, rows: int = FEW_ROWS, most: int = FEW_BYTES) -> bool:
    """Whether a table may be broadcast: its rows and the bytes of its texts are counted, up to the limit."""
    sizes = [F.octet_length(c) if t == "string" else F.octet_length(F.to_json(F.struct(c))) for c, t in df.dtypes if t == "string" or t.startswith(("array", "map", "struct"))]
    total = F.sum(sum((F.coalesce(x, F.lit(0)).cast("long") for x in sizes), F.lit(0).cast("long"))) if sizes else F.lit(0)
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), total).first()
    return n <= rows and (size or 0) <= most


def join_lookup(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", few: bool | None = None, salts: int = 16) -> DataFrame:
    """big joined by a key with a table of few rows for each key. A table that fits (few: whether it does, where that is
    known) is broadcast; of another each row is repeated for all salts, and big's rows of one key, which may be a third
    of all, spread over them."""
    if fits(small) if few is None else few:
        return big.join(F.broadcast(small), on, how)
    on = [on] if isinstance(on, str) else on
    plain = [c for c, t in big.dtypes if not t.startswith(("array", "map", "struct"))]
    wide = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # A null key meets nothing, so its rows may spread further.
    salt = F.pmod(F.xxhash64(*plain), F.when(F.col(on[0]).isNull(), salts * 256).otherwise(salts)).cast("int")
    return big.withColumn("__salt", salt).join(wide, [*on, "__salt"], how).drop("__salt")
