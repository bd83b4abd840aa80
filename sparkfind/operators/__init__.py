"""Parts of the engine."""
