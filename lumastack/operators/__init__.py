"""operators of the frame-stack engine."""
