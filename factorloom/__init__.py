"""Context-aware prediction with factorization machines as Spark DataFrame jobs."""

from factorloom.params import FMParams
from factorloom.model import Model

__all__ = ["FMParams", "Model"]
