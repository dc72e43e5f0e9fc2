"""Stratified samples that merge: of every group the rows with the smallest digests.

Spark keeps `k` rows of a group in each task before the shuffle, so a sample of a bank of any size sends k rows a task and group. The
sample of a union is the sample of the samples, so it can be stored and brought up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bottom_k(rows: DataFrame, k: int, groups: list[str], id_column: str = "id", seed: str = "") -> DataFrame:
    """`rows` with `draw`, the place from 1 by digest within its group: the first `k` of each. Ids are unique."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    order = Window.partitionBy(*groups).orderBy(digest, id_column)
    return rows.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= k)


def merged(samples: list[DataFrame], k: int, groups: list[str], id_column: str = "id", seed: str = "") -> DataFrame:
    """The sample of the union of the rows that `samples` (of k or more, with the same seed) were drawn from; these must not overlap."""
    both = samples[0]
    for sample in samples[1:]:
        both = both.unionByName(sample)
    return bottom_k(both.drop("draw"), k, groups, id_column, seed)


def by_quotas(rows: DataFrame, quotas: dict[str, int], group: str, id_column: str = "id", seed: str = "") -> DataFrame:
    """An exam: of each group as many rows as its quota says, fewer where it has fewer; other groups give none."""
    wanted = {g: n for g, n in quotas.items() if n > 0}
    if not wanted:
        return rows.withColumn("draw", F.lit(0)).limit(0)
    quota = F.try_element_at(F.create_map(*[x for g, n in wanted.items() for x in (F.lit(g), F.lit(n))]), F.col(group))
    drawn = bottom_k(rows.where(F.col(group).isin(list(wanted))), max(wanted.values()), [group], id_column, seed)
    return drawn.where(F.col("draw") <= quota)
