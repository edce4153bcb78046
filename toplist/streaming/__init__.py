"""Streaming: intentionally empty.

The chart engine being reproduced has no stream sources, watermarks,
event-time windows or stateful operators; its index is rebuilt in batch
when annual CSV files change (``toplist.operators.index``).  Chart files are
replaced in place rather than appended, which a file-stream source would not
see, so no Structured Streaming job is defined here.
"""
