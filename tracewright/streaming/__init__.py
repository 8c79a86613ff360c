"""Job events as a stream."""
