"""veilframe: finds, masks and restores sensitive text in Spark DataFrames."""

from veilframe.config import MaskConfig, PatternSpec

__all__ = ["MaskConfig", "PatternSpec"]
