"""plans layer of the stowage engine."""
