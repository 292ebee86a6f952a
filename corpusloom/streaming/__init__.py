"""Appending a run's metrics as they arrive."""

from corpusloom.streaming.metrics import logged_once, long_metrics, stream_metrics

__all__ = ["logged_once", "long_metrics", "stream_metrics"]
