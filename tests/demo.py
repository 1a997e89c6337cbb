"""The small synthetic calibration tasks, under the name that the tests use."""

from .scenarios import *  # noqa: F403
from .scenarios import CLAIM, D2, D3, D4, D5, D6  # noqa: F401
