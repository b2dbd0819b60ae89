"""DataFrame operators by subject."""
