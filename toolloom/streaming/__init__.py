"""The same scoring over streams, and a stateful router."""
