"""Compositions: the warehouse load, the graphs and the registered queries."""
