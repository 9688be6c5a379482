"""Version tokens and compatibility levels."""

from pyspark.sql import Column, functions as F

# The levels a user may set, and the level when nothing is set.
SETTABLE_LEVELS = ["NONE", "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FULL"]
DEFAULT_LEVEL = "NONE"
GLOBAL_SUBJECT = "_GLOBALCONFIG"


def is_latest(token: Column) -> Column:
    return F.lower(token) == "latest"


def version_number(token: Column) -> Column:
    """The number in a token, null for ``latest``, text that is no number, and numbers below 1."""
    number = token.try_cast("int")
    return F.when(number >= 1, number)


def is_settable(level: Column) -> Column:
    return F.coalesce(level.isin(SETTABLE_LEVELS), F.lit(False))
