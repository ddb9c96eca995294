"""Column functions: text, lexing, time, distances, numeric helpers."""
