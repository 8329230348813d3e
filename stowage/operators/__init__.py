"""operators layer of the stowage engine."""
