"""Column functions, all JVM-side except where a docstring says otherwise."""
