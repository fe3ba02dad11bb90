"""On-disk triple store: Parquet partitioned by predicate, so that a rule reads the predicates it names and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from axiograph.sources import mapping
from axiograph.sources.shared import new_path

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("graph", "s", "s_kind", "o", "o_kind", "o_dt", "o_lang", "p")])
#: Rows of a file, at most. Tasks are given files by their bytes, which say little of the rows (columns of few names compress to almost nothing):
#: one large file would be one task's.
FILE_ROWS = 50_000
_stores: dict[tuple[str, str], str] = {}


def write_store(triples: DataFrame, path: str, mode: str = "error") -> None:
    """Rows are rebalanced by predicate first: few files for each, and a large predicate in several of up to FILE_ROWS rows, for many tasks."""
    triples.hint("rebalance", "p").write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("p").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def testbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped tables of sf_dir as a store that is written once for each Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        path = new_path(spark, "store")
        write_store(mapping.triples(spark, sf_dir), path)
        _stores[key] = path
    return read_store(spark, _stores[key])
