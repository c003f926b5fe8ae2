"""plans of the frame-stack engine."""
