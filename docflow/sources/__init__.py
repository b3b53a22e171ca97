"""docflow sources."""
