"""New responses of the landing zone, each taken once.

The file source's checkpoint is the mark of what is done: a further run opens no old file, and nobody
has to say from which day on there is something new. A micro-batch is parsed once;
what a replay repeats is absorbed by the unique keys of the tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carrygrid.functions.names import lookup_key

from . import registry
from .landing import stream_landing
from .records import accept, is_failfast, rejected
from .warehouse import Warehouse

Apply = Callable[[DataFrame, int], object]


def consume(wh: Warehouse, landing: str, kind: str, apply: Apply, checkpoint: str, exchange: str | None = None,
            mode: str = "quarantine", every: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """Give the usable records of each micro-batch, and the number of unusable ones, to ``apply``.

    In quarantine mode unusable records are stored aside, before anything else; in failfast mode the first one
    stops the run, whose batch is then tried again by the next. Without ``every`` the backlog is read once.
    """
    # Batches are numbered by checkpoint, so the checkpoint names the run.
    run = hashlib.md5(checkpoint.encode()).hexdigest()
    strict = is_failfast(mode)

    def on_batch(responses: DataFrame, batch_id: int) -> None:
        if responses.isEmpty():
            return
        parsed = registry.parse(responses, kind, mode).persist()
        try:
            bad = 0
            if not strict:
                wh.store_rejects(kind, run, batch_id, rejected(parsed))
                bad = rejected(parsed).count()
            apply(accept(parsed, strict), bad)
        finally:
            parsed.unpersist()

    responses = stream_landing(wh.spark, landing, kind, max_files)
    if exchange is not None:
        responses = responses.where(lookup_key(F.col("exchange")) == exchange.strip().lower())
    writer = responses.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
