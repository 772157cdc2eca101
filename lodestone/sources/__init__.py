"""Point and splat sources."""
