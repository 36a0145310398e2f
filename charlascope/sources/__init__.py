"""CSV sources and report sinks."""
