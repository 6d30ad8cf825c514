"""Writing results so that runs can be repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orbitweave.session import durable


def append_new(df: DataFrame, path: str, keys: list[str], overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Writes the rows whose keys aren't at ``path`` yet; with ``overwrite`` all rows, in place of what is there."""
    if not overwrite:
        try:
            df = df.join(df.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    df.write.mode("overwrite" if overwrite else "append").partitionBy(*(partition_by or [])).parquet(path)


def grouped_by_prefix(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Columns that begin with a prefix as fields of one struct a group; the others as they are."""
    group_of = {c: next((g for p, g in prefixes.items() if c.startswith(p)), None) for c in df.columns}
    structs = [F.struct(*[F.col(c).alias(c.removeprefix(p)) for c in df.columns if group_of[c] == g]).alias(g) for p, g in prefixes.items() if g in group_of.values()]
    return df.select(*[c for c in df.columns if group_of[c] is None], *structs)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """CSV with a header; timestamps to the microsecond."""
    df.write.partitionBy(*(partition_by or [])).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=True)


def write_manifests(df: DataFrame, path: str) -> None:
    """A line of JSON a row, with its keys in alphabetical order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


#: Folders of a commit log, and keys up to which a write asks the log for each by its hash.
LOG_BUCKETS = 64
MOST_ASKED = 1000


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def write_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """(keys, path, created) of each key of ``df``: rows of new keys are written, those of known ones skipped.

    Keys are known from a log that holds nothing but keys and the commit that wrote them, in folders by hash and sorted,
    with a Bloom filter in each file: a write reads the folders of its own keys, and of few keys only row groups whose
    filter may hold one. Rows are written before the log names their commit, and are not read before that, so that a
    write that fails leaves nothing behind but unread files. Null keys equal each other. One writer at a time.
    """
    spark = df.sparkSession
    hashed = durable(df.withColumn("__hash", F.xxhash64(*keys)))
    asked = hashed.select(*keys, "__hash", F.pmod(F.xxhash64(*keys), F.lit(LOG_BUCKETS)).cast("int").alias("__bucket")).distinct()
    log, known = _log(spark, path), None
    if log is not None:
        own = [r[0] for r in asked.select("__bucket").distinct().collect()]
        known = log.filter(F.col("bucket").isin(own))
        few = asked.select("__hash").limit(MOST_ASKED + 1).collect()
        if len(few) <= MOST_ASKED:
            known = known.filter(F.col("hash").isin([r[0] for r in few]))
        known = known.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "hash", "commit")
        same = asked["__hash"] == known["hash"]
        for i, k in enumerate(keys):
            same = same & asked[k].eqNullSafe(known[f"__k{i}"])
        asked = asked.join(known, same, "left")
    commit = uuid.uuid4().hex
    old = F.col("commit") if known is not None else F.lit(None).cast("string")
    status = durable(asked.select(*keys, "__hash", "__bucket", old.isNull().alias("created"), F.coalesce(old, F.lit(commit)).alias("commit")))
    fresh = status.filter("created")
    if not fresh.isEmpty():
        same = hashed["__hash"] == fresh["__hash"]
        for k in keys:
            same = same & hashed[k].eqNullSafe(fresh[k])
        hashed.join(fresh, same, "left_semi").drop("__hash").write.parquet(f"{path}/data/commit={commit}")
        rows = fresh.select(*keys, F.col("__hash").alias("hash"), "commit", F.col("__bucket").alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "hash").write.mode("append").option("parquet.bloom.filter.enabled#hash", "true").partitionBy("bucket").parquet(f"{path}/log")
    return status.select(*keys, F.concat(F.lit(f"{path}/data/commit="), "commit").alias("path"), "created")


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the commits that the log of :func:`write_new` names."""
    log = _log(spark, path)
    commits = [r.commit for r in log.select("commit").distinct().collect()] if log is not None else []  # one a run
    if not commits:
        raise ValueError(f"nothing is written at {path}")
    return spark.read.parquet(*[f"{path}/data/commit={c}" for c in commits])
