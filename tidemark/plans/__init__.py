"""Registered queries over the driver tables (see ``catalog``).

Importing the package loads the catalog first, so the query modules can be imported
in any order.
"""

from . import catalog  # noqa: F401
