"""loomline: template mining over tables and streams of text lines, on Spark.

Every public function takes and returns Spark DataFrames or Columns.
"""

from loomline.options import Mask, MinerOptions, DEFAULT_MASKS, TUNED_MASKS

__all__ = ["Mask", "MinerOptions", "DEFAULT_MASKS", "TUNED_MASKS"]
