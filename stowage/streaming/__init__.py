"""streaming layer of the stowage engine."""
