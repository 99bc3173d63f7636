"""pagemill: web pages to clean, token-efficient markdown as Spark jobs.

Pages are parsed once into a ``nodes`` table (pre-order interval encoding);
cleanup, CSS selection, preset validation/application, markdown rendering,
reader-mode scoring, statistics and per-host preset induction are DataFrame
transformations over that table.
"""

from pagemill.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
