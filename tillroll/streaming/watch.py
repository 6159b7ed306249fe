"""Structured Streaming over arriving texts, one run per trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tillroll.options import Options
from tillroll.plans.batch import process_batch
from tillroll.sources.store import ReviewStore

# Fixed value: how often the folder is looked at.
POLL_INTERVAL = "15 minutes"


def watch(
    arriving: DataFrame,
    store: ReviewStore,
    checkpoint: str,
    options: Options = Options(),
    across_runs: bool = False,
    once: bool = False,
    last_uploads: bool = False,
) -> StreamingQuery:
    """Process every trigger's new texts as one run.

    The source log in `checkpoint` hands each file out once. A run id is claimed in the store
    for each batch of this checkpoint: a batch that is retried after a failure replaces what it
    had written, and nothing else does. `once` works off what is there and stops. With
    `last_uploads`, a name may come again in any trigger (`arrived_at`, `seq` tell which upload
    is the last); what is known of names lies in the store and is published with each run."""

    def run(batch: DataFrame, batch_id: int) -> None:
        run_id = store.run_of(checkpoint, batch_id)
        process_batch(
            batch, store, run_id, options, across_runs=across_runs, origin=f"{checkpoint}#{batch_id}",
            last_uploads=last_uploads,
        )

    writer = arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": POLL_INTERVAL}
    return writer.trigger(**trigger).start()
