"""How a buffer is cut into blocks and streams, decided before any byte is read."""
