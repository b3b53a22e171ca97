"""docflow operators."""
