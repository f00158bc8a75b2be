"""Multi-step jobs composed from operators."""
