"""Registered queries, and the operators composed into whole runs."""
