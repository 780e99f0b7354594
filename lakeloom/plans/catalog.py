"""Imports every plan module so that all queries are registered."""

from lakeloom.plans import io  # noqa: F401
from lakeloom.plans import matching  # noqa: F401
from lakeloom.plans import quality  # noqa: F401
from lakeloom.plans import relational  # noqa: F401
from lakeloom.plans import scalars  # noqa: F401
from lakeloom.plans import streams  # noqa: F401
from lakeloom.plans import coverage  # noqa: F401
from lakeloom.plans import skew  # noqa: F401
