"""Structured Streaming drivers around the batch operators."""
