"""sources of the frame-stack engine."""
