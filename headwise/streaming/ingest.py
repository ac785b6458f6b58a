"""Landed snapshots to appended scores rows, end to end."""
from headwise.operators.aggregates import earliest_arrival
from headwise.operators.filters import arrival_horizon_filter
from headwise.operators.windows import headway_lag
from headwise.session import write_and_read
from headwise.sources.feeds import feed_flatten
from headwise.sources.scores import append_scores, as_scores

# Each micro-batch numbers its own rows; batches take disjoint id ranges.
_ID_BITS = 32


def headways_from_snapshots(snapshots):
    """Batch form: flatten, horizon, earliest arrival per poll, headway."""
    return headway_lag(earliest_arrival(arrival_horizon_filter(feed_flatten(snapshots))))


def scores_sink(path):
    """``foreachBatch`` writer of headway rows; a repeated batch replaces itself."""
    def write(rows, batch_id):
        # Stored first: numbering reads the rows twice, and the state must advance once.
        rows = write_and_read(rows, "headway-batch")
        append_scores(as_scores(rows, first_id=batch_id << _ID_BITS), path, batch_id, clustered=True)
    return write
