"""Images as streams."""
