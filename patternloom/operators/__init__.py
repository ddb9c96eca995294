"""Operators over DataFrames of messages, tokens, patterns, histograms, tags and arrays."""
