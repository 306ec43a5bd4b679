"""Part of studylake."""
