"""Two versions of small given models: forests of three one-split trees and a basis of two components. They stand in for
trained ones where a query is held against SQL, which evaluates them from the same numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd

from . import params
from .operators.forest import ForestModel
from .operators.sequence import SequenceModel

# Of each tree: the feature, its split, the training rows to the left and to the right of it.
TREES = {
    1: (("z_score", 1.7137, 255, 1), ("dev_15", 1.5173, 254, 2), ("percentile", 0.9513, 250, 6)),
    2: (("dev_5", -1.3131, 2, 254), ("z_score", -1.2171, 3, 253), ("range_position", 0.0317, 1, 255)),
}
OFFSETS = {1: -0.7, 2: -0.68}
# Mean and std by which a metric type is normalised, and the errors from which a window is an anomaly.
NORMAL = {"cpu_usage": (25.0, 20.0), "memory_usage": (25.0, 20.0), "request_latency": (250.0, 200.0), "error_rate": (2.5, 2.0), "network_in": (50.0, 40.0)}
LIMITS = {1: 1.1, 2: 1.4}
ROWS = 256


def forest(version: int) -> ForestModel:
    nodes = []
    for t, (feature, split, left, right) in enumerate(TREES[version]):
        at = params.FEATURES.index(feature)
        nodes += [(t, 0, at, split, 1, 2, 0, left + right), (t, 1, -1, 0.0, -1, -1, 1, left), (t, 2, -1, 0.0, -1, -1, 1, right)]
    table = pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "depth", "size"])
    n = len(params.FEATURES)
    return ForestModel(params.FEATURES, [0.0] * n, [1.0] * n, table, OFFSETS[version], params.CONTAMINATION, ROWS, ROWS)


def sequence(version: int) -> SequenceModel:
    """A constant and a straight line, orthonormal."""
    n = params.SEQUENCE_LENGTH
    line = np.arange(n) - (n - 1) / 2
    basis = np.stack([np.full(n, n**-0.5), line / np.sqrt(line @ line)], axis=1)
    types = {k: {"mean": m, "std": s, "center": np.zeros(n), "components": basis, "threshold": LIMITS[version]} for k, (m, s) in NORMAL.items()}
    return SequenceModel(n, types)
