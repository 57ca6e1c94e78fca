"""Windows and features over unbounded input."""
