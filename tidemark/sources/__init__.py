"""Readers, the driver-table adapter, raw-table contracts and sinks."""
