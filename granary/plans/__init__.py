"""Plan shapes shared by the operators: slicing, ranks, carried state, small sides."""
