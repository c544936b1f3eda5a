"""docweave.functions."""
