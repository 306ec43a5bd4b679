"""Spark jobs for learning platforms: corpus cleaning, layout, sections, lessons, mastery, usage."""
