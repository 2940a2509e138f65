"""Column expressions of the engine; all of them run inside generated code."""
