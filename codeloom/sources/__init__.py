"""Sources, sinks and code extraction."""
