"""operators of resurvey."""
