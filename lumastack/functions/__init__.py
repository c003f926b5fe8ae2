"""functions of the frame-stack engine."""
