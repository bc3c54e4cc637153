"""Scalar functions of the transformation language, each ``Column... -> Column``.

Every argument that is not a Column is taken as a literal, so a column is named
with ``F.col``.  All functions are built-in Spark expressions (no Python UDF) and
work on batch and streaming DataFrames alike.  ``materialize`` and ``geo_location``,
which take tables, are in ``sluicework.operators``.
"""

from sluicework.functions.bitwise import *  # noqa: F401,F403
from sluicework.functions.conditional import *  # noqa: F401,F403
from sluicework.functions.convert import *  # noqa: F401,F403
from sluicework.functions.datetime import *  # noqa: F401,F403
from sluicework.functions.dynamic import *  # noqa: F401,F403
from sluicework.functions.dynamic import _zip as zip  # noqa: A004,F401
from sluicework.functions.math import *  # noqa: F401,F403
from sluicework.functions.predicates import *  # noqa: F401,F403
from sluicework.functions.special import *  # noqa: F401,F403
from sluicework.functions.text import *  # noqa: F401,F403
from sluicework.functions.types import *  # noqa: F401,F403
