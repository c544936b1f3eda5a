"""docweave.operators."""
