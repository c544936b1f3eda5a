"""docweave.streaming."""
