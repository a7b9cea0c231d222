"""Streaming.

The original application has no streaming path: no watermarks, no event-time
windows, no stateful operators (its only "stream" is an LLM response flag).
Nothing is built here on purpose. Scoring history is kept by the batch
append sink ``tidemark.sources.sinks.append_predictions``, which a scheduler
can call per batch; the same function works as a ``foreachBatch`` sink if
scored rows ever arrive as a stream.
"""
