"""What the corpus operators share: reading a table, cutting lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with at most so many rows and characters is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 1 << 26

#: Documents whose crc32(doc_id as text) has this remainder modulo 5 are held out of every fit.
FOLDS, HELD_OUT = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (one machine only)."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="ripplemark-")
        sc.setCheckpointDir(known)
        known = sc.getCheckpointDir()
    return known


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, and fixes what would differ on a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """Hint a broadcast only where the (staged) side has few rows, and these few characters as JSON."""
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= chars else df


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows, or where these are over n, those of least hashed keys, n less a twentieth of them on average: no task and no driver ranks the table."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(0.95 * n / total * (1 << 30)))


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns in the given types, and no others: extra columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.items()])


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns `apart`, and all others as one struct `row`, so that no name of theirs can clash."""
    others = [c for c in docs.columns if c not in apart]
    return docs.select(*[F.col(f"`{c}`") for c in apart], F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("string").alias("none")]).alias("row"))


def unpacked(df: DataFrame, like: DataFrame, *apart: str) -> DataFrame:
    """The columns of `like`, in its order, out of what packed() made with the same columns `apart`."""
    return df.select(*[F.col(f"`{c}`") if c in apart else F.col(f"row.`{c}`").alias(c) for c in like.columns])
