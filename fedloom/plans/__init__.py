"""Session helpers and shared work tables."""
