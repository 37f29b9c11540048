"""Lists of operators as one lazy plan, and whole jobs."""
