"""Structured Streaming entry points.

The batch programs have no streaming part; the one live input is the GPU log,
which the monitor reads while training runs.  ``gpu_monitor`` ingests new log
lines as they arrive and leaves the step rule to the batch operators.
"""

from tessera.streaming.gpu_monitor import ingest_gpu_log, snapshot

__all__ = ["ingest_gpu_log", "snapshot"]
