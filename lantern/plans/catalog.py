"""All queries of the library and their SQL."""

from . import corpus, decide, evaluate, retrieve, settings, streams, tools  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
