"""Event-log operators: every function maps DataFrame(s) to a DataFrame."""
