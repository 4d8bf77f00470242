"""Time cells: keeping per-key work bounded in time.

A rule that looks back a fixed span never needs a whole key at once. Rows are put
in cells of fixed length; a row near the end of its cell is also shown to the next
cell as context. Grouping on (key, cell) instead of the key alone spreads one hot
key over as many tasks as there are cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def width_for(reach_us: int) -> int:
    """Cells twice as long as the rule looks back: half of the rows are shown to one more cell, and a hot key's cell holds no more than that span."""
    return max(2 * reach_us, 1)


def cell_of(us: Column, cell_us: int) -> Column:
    """Start of the cell a moment falls in."""
    return us - F.pmod(us, F.lit(cell_us))


def cells_seen_from(us: Column, reach_us: int, cell_us: int) -> Column:
    """Cells whose rows may look back at a row at ``us``: its own and maybe the next."""
    own = cell_of(us, cell_us)
    return F.when(us + reach_us >= own + cell_us, F.array(own, own + cell_us)).otherwise(F.array(own))


def last_before(
    probes: DataFrame,
    events: DataFrame,
    key: str,
    reach_us: int,
    *,
    inclusive: bool = False,
    cell_us: int | None = None,
) -> DataFrame:
    """As-of lookup: for each probe the last event of its key at most ``reach_us`` back.

    ``probes`` has ``key, t, id`` and any further columns; ``events`` has ``key, t, id``
    and a struct ``payload``. Order is ``(t, id)``. With ``inclusive`` an event at the
    probe's own moment counts. Adds ``found`` (the payload or null) and ``found_t``.
    """
    cell_us = cell_us or width_for(reach_us)
    if reach_us > cell_us:
        raise ValueError("the look-back span must fit in one cell")
    side = F.lit(1) if inclusive else F.lit(0)
    tie = F.lit(0).cast("bigint") if inclusive else F.col("id")
    seen = events.select(
        key, F.explode(cells_seen_from(F.col("t"), reach_us, cell_us)).alias("cell"), "t", tie.alias("tie"), "payload",
        (F.lit(1) - side).alias("kind"),
    )
    extra = [c for c in probes.columns if c != key]
    asked = probes.select(
        key, cell_of(F.col("t"), cell_us).alias("cell"), "t", tie.alias("tie"), side.alias("kind"),
        F.struct(*extra).alias("probe"),
    )
    mixed = seen.unionByName(asked, allowMissingColumns=True)
    back = Window.partitionBy(key, "cell").orderBy("t", "tie", "kind").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(F.col("payload").isNotNull(), F.struct("t", "payload"))
    hit = F.last(event, ignorenulls=True).over(back)
    near = F.col("t") - F.col("hit.t") <= reach_us
    return (
        mixed.withColumn("hit", hit)
        .filter(F.col("probe").isNotNull())
        .select(
            key,
            "probe.*",
            F.when(near, F.col("hit.payload")).alias("found"),
            F.when(near, F.col("hit.t")).alias("found_t"),
        )
    )
