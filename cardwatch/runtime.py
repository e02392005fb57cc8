"""Session settings, durable lineage cuts, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: a lookup side is broadcast only when it was counted to be at most this many narrow rows
BROADCAST_ROWS = 500_000
#: a card with more rows than this is split over several tasks
HOT_KEY_ROWS = 2_000_000
#: aimed-at rows per task where a hot key is cut into ranges
ROWS_PER_RANGE = 1_000_000


def build_session(app: str = "cardwatch", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Epoch seconds and clock hours must not follow the machine's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def setting(spark: SparkSession, name: str, default: int) -> int:
    """A ``spark.cardwatch.*`` override, so a cluster can tune limits without code."""
    return int(spark.conf.get(f"spark.cardwatch.{name}", str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="cardwatch-")
    return _LOCAL_FOLDERS[application]


#: fallback folders of local masters by application, since the setting cannot be changed on a running session
_LOCAL_FOLDERS: dict[str, str] = {}
#: folder of the innermost run whose intermediates go when it ends
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_RUN.get() or shared_dir(spark) + '/cardwatch'}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go to one folder that is deleted at the end; write what must last elsewhere."""
    path = fresh_path(spark, "run")
    token = _RUN.set(path)
    try:
        yield
    finally:
        _RUN.reset(token)
        remove(spark, path)


def own_context(fn: Callable) -> Callable:
    """``fn`` for a thread pool, with the run folder of the thread that asks for it."""
    context = copy_context()
    return lambda *args: context.copy().run(fn, *args)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table outlives a lost executor and fixes anything that would differ on a re-run.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def lookup_join(df: DataFrame, table: DataFrame, on: str | list[str], how: str = "left",
                max_rows: int | None = None) -> DataFrame:
    """Join a lookup table: broadcast if it is counted small, else a shuffle join (AQE splits skew)."""
    limit = setting(df.sparkSession, "broadcastRows", BROADCAST_ROWS) if max_rows is None else max_rows
    return df.join(F.broadcast(table) if at_most(table, limit) else table, on, how)


def fits_broadcast(table: DataFrame) -> bool:
    return at_most(table, setting(table.sparkSession, "broadcastRows", BROADCAST_ROWS))


def bounded(table: DataFrame, rows: int) -> DataFrame:
    """Mark a table for broadcast when its row count, known to be at most ``rows``, is small."""
    small = rows <= setting(table.sparkSession, "broadcastRows", BROADCAST_ROWS)
    return F.broadcast(table) if small else table


def one_row(table: DataFrame) -> Column:
    """A one-row table as a struct column (an uncorrelated scalar subquery)."""
    return table.select(F.struct(*table.columns).alias("row")).scalar()


def literal_row(table: DataFrame) -> Column:
    """A one-row table as a struct of constants, which the optimizer folds away."""
    row = table.first()
    return F.struct(*[F.lit(row[c]).alias(c) for c in table.columns])


class HotKeys:
    """The keys with more rows than one task should hold, as a stored table; null is no key.

    There are at most rows / HOT_KEY_ROWS of them, so the table stays small; it is broadcast only if its count allows.
    """

    def __init__(self, df: DataFrame, key: str):
        spark = df.sparkSession
        floor = setting(spark, "hotKeyRows", HOT_KEY_ROWS)
        heavy = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > floor)
        table = stored(heavy, "hot-keys")
        self.key = key
        self.count, self.rows = (n or 0 for n in table.agg(F.count("*"), F.sum("n")).first())
        self._keys = bounded(table.select(key), self.count)

    def __bool__(self) -> bool:
        return self.count > 0

    def pick(self, df: DataFrame) -> DataFrame:
        return df.join(self._keys, self.key, "left_semi")

    def rest(self, df: DataFrame) -> DataFrame:
        return df.join(self._keys, self.key, "left_anti") if self else df
