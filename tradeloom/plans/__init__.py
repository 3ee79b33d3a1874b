"""Multi-step builds: staging, dimensions, wide fact, clean warehouse, dashboard base."""
