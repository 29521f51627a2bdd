"""Column builders: text in, column out, all on the JVM unless a docstring says otherwise."""
