"""Imports every module that registers queries."""

from .functions import sql_functions  # noqa: F401
from .operators import admission, catalogue, content, coverage, editorial, events, feeds, files, fuzzy, growth, items, judging, laws, learning, ordered, preparation, review, sketches, sources, text, training  # noqa: F401
from .registry import CORE
from .streaming import jobs, stateful  # noqa: F401

__all__ = ["CORE"]
