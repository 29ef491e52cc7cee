"""Sources and sinks of weights."""
