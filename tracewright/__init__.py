"""Object-centric process analytics on Spark DataFrames."""

from tracewright.config import Experiment, LogSpec, SourceColumns, Vocabulary
from tracewright.operators.skew import Skew

__all__ = ["Experiment", "LogSpec", "Skew", "SourceColumns", "Vocabulary"]
