"""Importing this package registers every named query and its oracle."""

from aerocast.catalog import io, models, profiling, series, streams, tables  # noqa: F401
