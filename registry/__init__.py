"""Registered queries and, where one can be written, the equal SQL for a second engine."""
