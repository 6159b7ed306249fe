"""Receipt review on Spark: extract, de-duplicate and queue financial documents."""

from tillroll.options import Options

__all__ = ["Options"]
