"""Column expressions. Everything here stays JVM-side unless its docstring says otherwise."""
