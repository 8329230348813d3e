"""sources layer of the stowage engine."""
