"""Session, tables and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "quillspark", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with; on a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share. ``spark.checkpoint.dir`` names it; only where that is unset and all tasks run in
    this process (as in local tests) a temporary folder of this machine is made, kept in the session's settings and
    removed at exit. On a cluster such a folder would be another one on each machine: an error."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{key} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(key, found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, and a lost executor costs
    no recomputation since the files outlive it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, those whose key has the smallest hash: the same rows whatever the partitioning.
    Rows beyond about the bound are filtered where they are read, so what is sorted does not grow with ``df``."""
    n = df.count()
    if n <= most:
        return df
    buckets = 1 << 24
    share = min(1.0, (most + 6 * most**0.5 + 16) / n)
    picked = df.where(F.pmod(F.xxhash64(key), F.lit(buckets)) < int(share * buckets) + 1)
    return picked.orderBy(F.pmod(F.xxhash64(key), F.lit(buckets)), key).limit(most)


def sequential(df: DataFrame, keys: list[str], order: list, start, step, column: str, kind: str) -> DataFrame:
    """Adds ``column``: ``step(state, row)`` for each row of a key in ``order``, with a state made by ``start()`` at the
    first row of each key. For operators whose every result depends on the one before.

    One shuffle by key and a sort that may spill; the tasks stream over their rows with the state of one key at a time,
    so neither many small keys nor one large key is collected."""
    import pyarrow as pa

    names = df.columns
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    at = [names.index(k) for k in keys]

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                now = tuple(row[i] for i in at)
                if state is None or now != key:
                    key, state = now, start()
                out.append(step(state, dict(zip(names, row))))
            yield b.append_column(column, pa.array(out, pa.bool_() if kind == "boolean" else pa.int32() if kind == "int" else pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{column}` {kind}"
    return placed.mapInArrow(run, schema)
