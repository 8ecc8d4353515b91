"""wordfold: word association tables and sparse matrix factorization on Spark.

Text -> windowed (word, context) pairs -> counts -> PMI / PPMI, factorization of
any (i, j, v) table, and similarity / ranking queries, all as DataFrame plans.
"""

from wordfold.session import get_spark, checkpoint_dir, cut_lineage, size_bounded_broadcast

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage", "size_bounded_broadcast"]
