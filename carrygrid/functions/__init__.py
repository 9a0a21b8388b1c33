from . import classes, display, names, numbers, timing

__all__ = ["classes", "display", "names", "numbers", "timing"]
