"""Profiles, the synthetic page layer, the optional PDF reader and the CSV sink."""
