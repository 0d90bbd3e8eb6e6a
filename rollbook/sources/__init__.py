"""Reading source files and writing reports."""
