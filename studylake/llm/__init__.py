"""Operators of a training-data pipeline: one module each, with the registered queries in :mod:`studylake.llm.queries`."""
