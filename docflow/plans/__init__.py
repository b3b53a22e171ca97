"""docflow plans."""
