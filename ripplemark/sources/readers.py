"""Readers of landed files and writers of processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

UNIVERSE = "ent string, name string, sector string, country string"
SEED_EDGES = "src string, dst string, rel string, w double"
ARTICLES = "article_id bigint, published_at timestamp_ntz, url string, domain string, lang string, title string, text string"
PRICES = "ent string, dt date, px double, vol double"
FILINGS = "filing_id bigint, ent string, filed_at timestamp_ntz, form string, text string"
KEYWORDS = "keyword string, category string, weight decimal(9,4)"


CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """The schema's columns by their names in the header, and what could not be read; columns that the files lack are null.

    Files of one path have one order of columns: a file with another one raises.
    """
    options = {"header": True, "escape": '"', "mode": "PERMISSIVE", **options}
    contract = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    head = spark.read.options(**options).csv(path).columns
    found = StructType([StructField(c, contract.get(c, StringType())) for c in head] + [StructField(CORRUPT, StringType())])
    rows = spark.read.schema(found).options(enforceSchema=False, columnNameOfCorruptRecord=CORRUPT, **options).csv(path)
    return rows.select(*[F.col(f"`{c}`") if c in head else F.lit(None).cast(t).alias(c) for c, t in contract.items()], CORRUPT)


def _whole(rows: DataFrame) -> DataFrame:
    return rows.drop(CORRUPT)


def read_universe(spark: SparkSession, glob: str) -> DataFrame:
    """All files of the glob, one row for each ent: the first by file name. Columns are matched by name."""
    files = sorted(r.path for r in spark.read.format("binaryFile").load(glob).select("path").collect())  # one for each source of the universe
    rows = spark.createDataFrame([], f"{UNIVERSE}, _file string")
    for path in files:  # each with its own order of columns
        rows = rows.unionByName(_whole(_csv(spark, path, UNIVERSE)).withColumn("_file", F.lit(path.rpartition("/")[2])))
    first = Window.partitionBy("ent").orderBy("_file", "name", "sector", "country")
    return rows.filter("ent IS NOT NULL").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_file")


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """One ticker a line: trimmed, upper-case, without blanks and repeats."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("ent")).filter("ent <> ''").distinct()


def restrict(df: DataFrame, tickers: DataFrame) -> DataFrame:
    return df.join(tickers.select("ent"), "ent", "left_semi")


def read_seed_edges(spark: SparkSession, path: str) -> DataFrame:
    return _whole(_csv(spark, path, SEED_EDGES))


def read_articles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Articles with quoted multi-line text, and the rows that could not be read, kept aside in _corrupt_record."""
    rows = _csv(spark, path, ARTICLES, multiLine=True)
    return _whole(rows.filter(F.col(CORRUPT).isNull())), rows.filter(F.col(CORRUPT).isNotNull())


def read_prices(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    if kind == "parquet":
        return spark.read.schema(PRICES).parquet(path)
    return _whole(_csv(spark, path, PRICES))


def read_filings(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(FILINGS).json(path) if kind == "json" else _whole(_csv(spark, path, FILINGS, multiLine=True))


def read_risk_keywords(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return spark.read.schema(KEYWORDS).json(path) if kind == "json" else _whole(_csv(spark, path, KEYWORDS))


def conform(df: DataFrame, contract: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    """The contract's columns, cast; what fails becomes null, and <column>_failed says so. names: contract name -> column."""
    out = []
    for c, t in contract.items():
        source = (names or {}).get(c, c)
        x = F.col(f"`{source}`") if source in df.columns else F.lit(None)
        cast = x.cast("string").try_cast(t)
        out += [cast.alias(c), (x.isNotNull() & cast.isNull()).alias(f"{c}_failed")]
    return df.select(*out)


def write_processed(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet; a rerun replaces the partitions that it writes and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_report_tables(tables: dict[str, DataFrame], folder: str, kind: str = "json") -> None:
    """Each (small) report table as one file in its own folder."""
    for name, df in tables.items():
        w = df.coalesce(1).write.mode("overwrite")
        w.json(f"{folder}/{name}") if kind == "json" else w.parquet(f"{folder}/{name}")
