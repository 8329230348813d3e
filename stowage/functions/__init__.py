"""functions layer of the stowage engine."""
