"""Market-decision analytics as PySpark DataFrame functions.

Every public function takes and returns DataFrames and stays lazy. Series are
keyed by ``asset``; one long series is cut into time chunks so that it runs on
many tasks (see ``tidemark.operators.chunks``).
"""

__version__ = "0.1.0"
