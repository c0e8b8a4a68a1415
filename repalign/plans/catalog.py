"""Import every plan module so that its queries register."""

from . import encoding, inference, reports, similarity, stimuli, text  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
