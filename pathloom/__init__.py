"""pathloom: counting, enumeration and estimation of paths through every vertex of a graph, as Spark dataflow."""

__version__ = "0.1.0"
