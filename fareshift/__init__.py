"""fareshift: transit ridership analysis on Spark DataFrames."""

from fareshift.operators.asof import asof_join, last_position, with_last_position  # noqa: F401
from fareshift.session import get_session  # noqa: F401
