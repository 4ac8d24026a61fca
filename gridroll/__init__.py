"""gridroll: a Spark-native rollup-cube engine.

Declare dimensions, measures and the exact dimension combinations worth
keeping; gridroll compiles that declaration into DataFrame plans that build,
incrementally maintain, query and backfill the resulting aggregate cells.
"""

__version__ = "0.1.0"
