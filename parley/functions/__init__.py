"""Column functions: scalars that stay inside whole-stage code generation."""
