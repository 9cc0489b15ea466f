"""Column expressions: colour, geometry and block arithmetic, all inside whole-stage code generation."""
