"""Source code as tables: extraction of symbols and calls, and their resolution to a call graph."""
