"""Training-data operators. Nothing else in docflow imports this subpackage."""
