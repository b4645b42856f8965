"""Training-data operators (numbered 1-10) and the queries that apply them."""
