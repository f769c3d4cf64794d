"""Column expressions for tile arithmetic and hashing; all plan as ordinary Catalyst expressions."""

from .hashing import fmix64, keep_point, retention_rate, unit_interval  # noqa: F401
from .tilemath import *  # noqa: F401,F403
