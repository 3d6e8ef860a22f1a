"""Column functions: content hashes, JSON paths, text and presence scalars, inverse operations."""
