"""functions of resurvey."""
