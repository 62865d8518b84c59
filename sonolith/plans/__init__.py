"""Pipelines (stage compositions), sizing helpers and the query catalog."""
