"""Multi-step jobs and the tables they stage."""
