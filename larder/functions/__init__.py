"""Column expressions. Everything here runs inside the JVM except the rare-character path of text.py."""
