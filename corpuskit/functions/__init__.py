"""Column-level functions (``Column -> Column``), all built-in Spark expressions."""

from corpuskit.functions.text import *  # noqa: F401,F403
from corpuskit.functions.tokens import *  # noqa: F401,F403
