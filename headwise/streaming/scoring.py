"""Incremental scoring in micro-batches."""
from headwise.plans.cycles import score_from_state
from headwise.session import write_and_read
from headwise.sources.scores import rewrite_scores


def stream_score(state_path, sink):
    """``foreachBatch`` function: score a micro-batch from the state after the one before it.

    The stream's rows should come in time order. State versions are named by the batch, so a repeated
    micro-batch starts from the same state. ``sink(scored, batch_id)`` stores the scored rows.
    """
    def write(rows, batch_id):
        # Stored first: scoring reads the rows more than once.
        rows = write_and_read(rows, "score-batch")
        scored, _ = score_from_state(rows.sparkSession, rows, state_path, f"{batch_id:016d}")
        sink(scored, batch_id)
    return write


def to_folder(path):
    """Sink: scored rows as one folder per micro-batch, which a repeated one replaces."""
    def write(scored, batch_id):
        scored.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def write_back(scores_path):
    """Sink: scored rows into the scores table. The update sets values by id, so repeating it changes nothing."""
    def write(scored, batch_id):
        rewrite_scores(scored.sparkSession, scores_path, scored)
    return write
