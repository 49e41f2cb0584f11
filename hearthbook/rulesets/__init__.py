"""Word lists, patterns, lookup tables and cut-offs the operators take as defaults.

Every table here is data. Each operator that uses one takes it as an argument, so users swap in
their own without touching code.
"""
