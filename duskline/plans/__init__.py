"""The dialect: grammar, compiler, catalog and engine."""
