"""Single records scored as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.score import Scorer, score


def score_stream(
    records: DataFrame, scorer: Scorer, path: str, keep: Sequence[str], checkpoint: str, model: str | None = None, once: bool = False
) -> StreamingQuery:
    """Append the predictions of a stream of raw records to a Parquet table.

    Scoring reads only saved state, so the stream needs no state of its own. ``checkpoint`` is a folder
    in shared storage, one for each output path and the same at every restart: it tells the stream what
    has been read, so that each record counts once.
    """
    scored = score(records, scorer, model, keep)
    writer = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
