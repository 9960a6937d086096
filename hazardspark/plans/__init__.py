"""Registered queries: one module per subject, each with its SQL check."""
