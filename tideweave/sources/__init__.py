"""Tables, logs derived from them, and durable state."""
