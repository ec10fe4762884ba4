"""Nested queries over DataFrames: GraphQL in, Spark plans out."""
