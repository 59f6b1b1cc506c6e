"""Sources and sinks: session logs, configuration, stored tables."""
