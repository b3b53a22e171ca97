"""docflow streaming."""
