"""Training-data operators: large-scale corpus operations, each in a module of its own.

Nothing outside this subpackage imports it; ``loomvec.llm.registry`` holds its queries.
"""
