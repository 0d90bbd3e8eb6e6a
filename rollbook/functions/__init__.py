"""Column expressions shared by every operator; all run inside the JVM."""
