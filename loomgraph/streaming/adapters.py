"""Streams: stateless operators take streaming DataFrames as they are; these are the others."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.similarity import held_blocks, scores_with
from ..session import Message, Publish, Session
from ..subjects import with_batches


def similarity_stream(lhs: DataFrame, rhs: DataFrame, lhs_pk: str, rhs_pk: str, lhs_values: str, rhs_values: str, places: int | None = None) -> DataFrame:
    """Scores of a stream of right rows with a static left table, as of ``similarity_scores``; the left table is packed in blocks once, held, and broadcast to every micro-batch in waves of a checked size."""
    left = lhs.select(lhs_pk, F.col(lhs_values).alias("_u"))
    right = rhs.select(rhs_pk, F.col(rhs_values).alias("_v"))
    return scores_with(held_blocks(left, lhs_pk), left, right, lhs_pk, rhs_pk, places)


def superstep_stream(stream: DataFrame, session: Session, subject: str, checkpoint: str, how: str = "extend", handle=None) -> DataStreamWriter:
    """Every micro-batch is a batch of ``subject`` and drives supersteps until no task is ready; ``handle`` gets the session's own outputs.

    A micro-batch that was applied before a restart is not applied again while the session lives.
    """
    seen: set[int] = set()

    def run(rows: DataFrame, number: int) -> None:
        if number in seen or rows.isEmpty():
            return
        session.iter = 0
        message = Message(f"from_{session.name}_on_{subject}", subject, session.name, with_batches(rows), Publish(subject, how))
        for made in session.stream([message]):
            if handle:
                handle(made)
        seen.add(number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: rows and sums of ``value`` by event-time window and key; later rows than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "rows", "total")
