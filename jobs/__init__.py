"""Runnable jobs over a screen's tables: ``python -m jobs.molecules``, ``python -m jobs.screen_report``."""
