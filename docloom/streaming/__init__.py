"""The extraction over streams."""
