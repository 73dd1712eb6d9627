"""DataFrame operators: capability extraction and checks, validation, linting."""
