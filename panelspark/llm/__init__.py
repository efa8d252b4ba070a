"""Training-data operators: ten corpus-scale operations and the queries over them."""
