"""A PySpark engine for evaluating pairwise judges: triplet metrics, Best-of-N graphs, matching, statistics and integrity checks."""
