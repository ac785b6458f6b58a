"""Rolling quantiles of a batch-trimmed history."""
import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer

from headwise.schema import RESIDUAL_HISTORY, SCORING_BATCH


class _Before(BaseIndexer):
    """Windows of the given sizes that end just before each row."""

    def __init__(self, sizes):
        self.sizes = sizes
        super().__init__()

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        ends = np.arange(num_values, dtype=np.int64)
        return ends - self.sizes, ends


def history_quantiles(values, seq, probs):
    """History size before each row, and its quantiles.

    The history is trimmed to the newest values at batch starts: it holds the last 8000 values at the start
    of the row's batch and the earlier rows of that batch. ``values`` stand in order of ``seq`` without gaps.
    """
    batch_start = seq - seq % SCORING_BATCH
    sizes = np.minimum(np.minimum(batch_start, RESIDUAL_HISTORY) + seq - batch_start, np.arange(len(seq)))
    rolling = pd.Series(values).rolling(_Before(sizes.astype(np.int64)), min_periods=1)
    return sizes, [rolling.quantile(p).to_numpy() for p in probs]
