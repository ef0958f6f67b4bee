"""The same plans over streams of jobs."""
