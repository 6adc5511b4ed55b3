"""From raw documents to a training mix, in stages that hand over written tables.

Every stage takes the documents that its predecessor kept and returns the same
columns; the last adds the copies that the mix takes.  A stage that picks rows
gives each a number, by which its decisions find them again, however often and
wherever the table is read: the row's place in the Parquet files of the table,
or where docs is no such table, a number in a written copy.

Null and equal doc_ids are rows like others, as each stage's operator says; null
and empty texts are judged by their statistics and, where kept, stand for one
near-duplicate group; very long texts are read whole, one at a time in a task; other
columns are handed on whatever they are named; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import columns, packed, small, staged, table, unpacked
from ripplemark.llm.decontamination import decontaminate
from ripplemark.llm.mixing import mix
from ripplemark.llm.quality import keep_good
from ripplemark.llm.simhash import cluster
from ripplemark.llm.substring import dedup

READ = ("doc_id", "text", "source")


#: So many files of a table, of so many characters in the paths (small()), are numbered in a broadcast table; more are joined by a shuffle.
FILES = 400_000

#: A number holds a file's number above so many bits of the row's place in it.
PLACES = 40


def _places(docs: DataFrame) -> tuple[F.Column, F.Column] | None:
    """The file of each row and its place there, where docs is a table of Parquet files as written; None where rows come of anything else, such as a join, which could repeat them."""
    plan = getattr(docs, "_jdf", None)
    if plan is None or not plan.queryExecution().analyzed().children().isEmpty():
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["file_path"], meta["row_index"])
    except AnalysisException:
        return None
    return meta["file_path"], meta["row_index"]


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns that operators read, the others as one struct, and the number of each row, the same on every read."""
    rows, places = packed(docs, *[c for c in READ if c in docs.columns]), _places(docs)
    if places is None:
        return staged(rows.withColumn("rid", F.monotonically_increasing_id()))
    path, at = places
    files = staged(docs.select(path.alias("path")).distinct())
    files = files.select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("file"))  # one row a file
    placed = rows.select("*", path.alias("path"), at.alias("at")).join(small(staged(files), FILES), "path")
    return placed.select(*rows.columns, F.shiftleft("file", PLACES).bitwiseOR(F.col("at")).alias("rid"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on labels.quality, does not reject."""
    labels = columns(table(spark, sf_dir, "labels"), doc_id="long", quality="double").withColumnRenamed("quality", "label")
    return keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id. Unrelated documents stay, whether their doc_ids are null or equal or not."""
    rows = _numbered(docs)
    groups = staged(cluster(rows, "rid"))
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("k")).select(F.col("k.rid").alias("rid"))
    dropped = staged(groups.select("rid").join(kept, "rid", "left_anti"))
    return unpacked(rows.join(small(dropped), "rid", "left_anti"), docs, *READ)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a smaller doc_id has; those that consist of such passages go."""
    out = dedup(_numbered(docs), key="rid").filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    own = {c: F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"row.`{c}`") if c in READ else F.col(f"row.row.`{c}`") for c in docs.columns}
    own["text"] = F.coalesce("rest", "text")
    if "n_chars" in docs.columns:
        n_chars = F.length(own["text"]).cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.col("n_removed") > 0, n_chars).otherwise(own["n_chars"])
    return out.select(*[own[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; equal texts fare alike, so that they go by their 64-bit hashes and no row needs a number."""
    rows = packed(docs, "doc_id", "text").withColumn("h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = decontaminate(rows, columns(table(spark, sf_dir, "benchmark"), item_id="string", text="string"), key="h")
    hit = staged(found.filter("n_hit > 0").select(F.col("rid").alias("h")).distinct())
    return unpacked(rows.join(small(hit), "h", "left_anti"), docs, "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies and the words that these have: mix_copies and mix_taken, or where documents have such columns these names with more underscores in front. Without a source, all are of one that is null."""
    rows = _numbered(docs)
    rows = rows if "source" in docs.columns else rows.withColumn("source", F.lit(None).cast("string"))
    taken = mix(rows, key="rid").filter("copies > 0").select("rid", F.struct("copies", "taken").alias("mix"))
    both = rows.join(taken, "rid")
    own = [F.col(f"`{c}`") if c in READ else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return both.select(*own, F.col("mix.copies").alias(_free("mix_copies", docs)), F.col("mix.taken").alias(_free("mix_taken", docs)))


def _free(name: str, docs: DataFrame) -> str:
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: The stages are learned, iterative or random, so there is no SQL for their rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
