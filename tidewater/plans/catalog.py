"""Importing this module registers every query."""

from tidewater.plans import market, more, records, timeseries  # noqa: F401
