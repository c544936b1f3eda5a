"""docweave.sources."""
