"""Cars as a stream: every tick of elapsed seconds gives every car's place. Stateless, so a batch and a stream agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.network import positions


def ticks(spark, rate: int = 1, step: float = 0.1) -> DataFrame:
    """A stream of elapsed seconds."""
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select((F.col("value") * step).alias("elapsed"))


def follow(stream: DataFrame, cars: DataFrame, steps: DataFrame, sink):
    """Starts a query that gives sink(places, batch id) the places of all cars at each batch's ticks."""

    def batch(now: DataFrame, number: int) -> None:
        every = [r["elapsed"] for r in now.select("elapsed").distinct().collect()]  # the ticks of one batch
        if every:
            sink(positions(cars.withColumn("elapsed", F.explode(F.array(*map(F.lit, every)))), steps), number)

    return stream.writeStream.foreachBatch(batch).start()
