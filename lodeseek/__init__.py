"""Retrieval analytics on Spark: corpora in, ranked and evaluated answers out."""

from lodeseek.config import Tunables
from lodeseek.runtime import build_session, drop_stages, stage

__all__ = ["Tunables", "build_session", "drop_stages", "stage"]
