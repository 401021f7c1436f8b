"""Functions for expressions: aggregates, windows, conditionals and scalars."""

from .aggregates import *  # noqa: F403
from .conditionals import *  # noqa: F403
from .scalars import *  # noqa: F403
from .windows import *  # noqa: F403
