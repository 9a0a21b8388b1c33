from . import extended, landing, paradex, records, registry, warehouse

__all__ = ["extended", "landing", "paradex", "records", "registry", "warehouse"]
