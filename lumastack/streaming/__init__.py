"""streaming of the frame-stack engine."""
