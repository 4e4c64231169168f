"""Driver tables as canonical relations, and the registered queries over them."""
