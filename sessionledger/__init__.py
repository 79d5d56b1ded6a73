"""Session-log analytics on Spark: usage, turns, children, liveness and quota."""
