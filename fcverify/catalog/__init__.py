"""Registered queries."""

from fcverify.catalog import diagnosis, preparation, verification  # noqa: F401
from fcverify.catalog.base import ENTRIES

__all__ = ["ENTRIES"]
