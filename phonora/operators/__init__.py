"""Relational, nearest-neighbour, sequence, graph and evaluation operators over DataFrames."""
