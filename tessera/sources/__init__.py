"""Sources and sinks of images."""
