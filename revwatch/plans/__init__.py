"""Named queries over the warehouse."""
