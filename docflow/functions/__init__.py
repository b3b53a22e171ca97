"""docflow functions."""
