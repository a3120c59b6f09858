"""quarry: dataset and document analysis as Spark DataFrame jobs.

Tables get cleaned, profiled, charted (as chart-data tables) and screened for
outliers; document collections get paged, tokenised, scored and summarised.
Every public operator takes and returns DataFrames.
"""

from quarry.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
