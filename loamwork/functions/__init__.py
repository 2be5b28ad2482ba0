"""Canonical types, and column expressions that clean raw text by explicit token rules."""
