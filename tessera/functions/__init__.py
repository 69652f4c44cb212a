"""Scalar functions: Column in, Column out, all inside the JVM."""
