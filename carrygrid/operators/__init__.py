from . import arbitrage, board, facts, matrix, upserts, windows

__all__ = ["arbitrage", "board", "facts", "matrix", "upserts", "windows"]
