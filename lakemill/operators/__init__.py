"""Operators: filters, paging, aggregation, time series, profiles, statistics and search."""
