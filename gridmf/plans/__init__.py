"""Iterative plans (training schedules) and the registered query catalogue."""
