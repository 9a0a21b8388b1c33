from . import ingest, rolling

__all__ = ["ingest", "rolling"]
