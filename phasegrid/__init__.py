"""phasegrid: passages of play from match events, as Spark DataFrame jobs."""

from phasegrid.constants import Thresholds

__all__ = ["Thresholds"]
