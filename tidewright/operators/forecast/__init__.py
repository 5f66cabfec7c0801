"""Forecasters.  Simple ones are window and aggregate plans; the others fit one (series, candidate) group per call."""
