"""Streams of logs and jobs."""
