"""Cohort retention, loss and destination analysis on Spark DataFrames.

``spec``       what to compute: months, chains, channels, exclusions, labels
``functions``  column expressions (months, keys, labels)
``sources``    table bindings, stage reads and writes
``operators``  one function per stage: DataFrames and a spec in, a DataFrame out
``plans``      the stages put together: step by step, or fused for large data
"""

from lapsewise.spec import RetentionSpec

__all__ = ["RetentionSpec"]
