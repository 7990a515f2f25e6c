"""aerocast: sensor time-series feature tables and chained multi-horizon
forecasting, expressed as Spark DataFrame operators over many series at once.

Every operator takes and returns DataFrames; the work runs as Spark SQL
expressions, windows, aggregations, joins and Arrow tasks.
"""

from aerocast.config import FeatureSpec, ForecastSpec  # noqa: F401
from aerocast.session import get_session, scratch_path  # noqa: F401

__all__ = ["FeatureSpec", "ForecastSpec", "get_session", "scratch_path"]
