"""Training-data pipeline operators.

Nothing outside this subpackage imports it: delete the folder and the rest of
the library still works.  `registry` lists the registered queries.
"""
