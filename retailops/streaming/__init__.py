"""Streaming: intentionally empty.

The reference reads complete report exports once per run; it has no
watermark, event-time window, state or late data to reproduce.  Every
operator here is a batch DataFrame function, so the same functions can be
applied inside ``foreachBatch`` if new exports arrive as files.
"""
