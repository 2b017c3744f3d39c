"""Registered plans: the named queries over the driver tables and their
independent SQL formulations."""
