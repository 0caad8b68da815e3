"""Queries over the test tables, each with the SQL that must give the same rows."""

from . import catalogue, cleaning, history, learning, policies, scalars, storage, streams  # noqa: F401
from .registry import QUERIES, SQL, SURVEY_IDS  # noqa: F401
