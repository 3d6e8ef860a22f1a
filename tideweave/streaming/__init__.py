"""The lattice aggregates over streams, and stateful processors where order or time matters."""
