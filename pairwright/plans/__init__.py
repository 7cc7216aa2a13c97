"""Registered queries (importing the query modules fills the registry)."""

from . import q_docs, q_events, q_games, q_io, q_models, q_prep, q_student  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
