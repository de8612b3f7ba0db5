"""Schema readers, reference data and sinks."""
