"""docweave.plans."""
