"""Operators over DataFrames: cubes, factor algebra, contractions, synthesis."""
