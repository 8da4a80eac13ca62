"""The registered queries: bindings of the test tables and their SQL twins."""
