"""sources of resurvey."""
