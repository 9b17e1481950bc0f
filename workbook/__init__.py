"""Worked queries: every operator applied to whole test tables, each with the SQL that checks it."""

from . import base, models, places, survey  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
