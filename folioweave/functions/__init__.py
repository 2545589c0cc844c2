"""Column functions: pure expressions that stay in generated code wherever Spark has the parts."""
