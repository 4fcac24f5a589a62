"""Registered queries over the driver's tables, one module per family."""
