"""The size of what Spark hands to Python at a time.

By default a batch holds 10,000 rows, whatever they weigh: whole texts or token arrays of that many rows, and what a
function makes of them, take GBs in each worker. Bounded by bytes, a worker's memory follows its longest row, not the table.

Spark then asks for a batch's size at each row, and a list column answers by filling in all null lists since its last list: rows with null lists
take time quadratic in the batch. So functions in Python get empty lists in place of null ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = 1 << 20


def small(spark: SparkSession | None = None) -> None:
    """Batches of the session have about ``MOST_BYTES`` from now on; one row may be larger. A smaller setting stays.

    All functions in Python call this where they are made, as a plan reads the setting when it runs.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    now = spark.conf.get(OPTION).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= MOST_BYTES:
        spark.conf.set(OPTION, MOST_BYTES)
