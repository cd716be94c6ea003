"""Analysis of log objects as they arrive: each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import RuleConfig
from vigil.operators.detect import detect
from vigil.operators.report import source_counts
from vigil.sources.logs import parse_ssh, parse_web


def arriving_lines(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """Lines of new files that match the pattern, as a stream."""
    return spark.readStream.option("pathGlobFilter", glob).text(folder).select("value", F.col("_metadata.file_path").alias("source_file"))


def analyse_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: RuleConfig = RuleConfig(), year: int | None = None, glob: str = "*.log"):
    """Analyse files that have not been analysed yet and end; results (source_file, events, incidents and counts by type) go to out
    as Parquet, partitioned by batch. A batch that is tried again replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            events = parse_ssh(batch, year).unionByName(parse_web(batch))
            source_counts(events, detect(events, cfg, ("source_file",))).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")
        finally:
            batch.unpersist()

    query = arriving_lines(spark, folder, glob).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
