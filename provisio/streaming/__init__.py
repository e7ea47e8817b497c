"""Incremental landing of yearly files with Structured Streaming.

The method itself is a batch computation for one evaluation date; the only
incremental part is the arrival of files per year slot.  ``landing`` lands
claims files dropped under ``<root>/Exercice=YYYY/`` as they arrive.
"""
