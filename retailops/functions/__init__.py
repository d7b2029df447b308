"""Column-level functions (scalar expressions and small plan helpers)."""

from .scalars import *  # noqa: F401,F403
from .ranking import global_rank, minmax_scale  # noqa: F401
