"""Jobs that combine sources, operators and sinks."""
