"""Training-data operators.

Nothing outside this subpackage imports it.  ``queries`` registers the
digest queries; every operator module keeps its own general interface.
"""
