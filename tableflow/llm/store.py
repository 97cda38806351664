"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableflow.session import apply_settings, work_dir

# A batch of texts on its way to Python, in rows and bytes, whichever is reached first.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> None:
    """Bring a session to the settings that the operators of this package count on."""
    apply_settings(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: later steps read it again instead of working it out again."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
