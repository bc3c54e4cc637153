"""Table operators of the transformation language."""

from sluicework.operators.enrich import geo_location, ip_bits, ip_location  # noqa: F401
from sluicework.operators.tabular import (  # noqa: F401
    ANY, columnifexists, extend, let, let_function, materialize, parse, project, project_away, project_rename,
    time_column, where,
)
