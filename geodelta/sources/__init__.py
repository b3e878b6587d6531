"""Sources and sinks: the framed chunk log."""
