"""Analytics over tables whose columns are split between two parties, as Spark jobs."""

from .session import local_session, materialise, shared_dir
from .spec import Party, TableSpec

__all__ = ["Party", "TableSpec", "local_session", "materialise", "shared_dir"]
