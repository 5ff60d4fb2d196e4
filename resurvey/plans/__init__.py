"""plans of resurvey."""
