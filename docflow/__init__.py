"""docflow: document-to-retrieval analytics expressed as Spark DataFrame plans."""
