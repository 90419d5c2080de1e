"""Timeline editing as projections, windows and ordered folds over clip rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ripple(clips: DataFrame, moved: Column, shift: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Shift the clips that ``moved`` names; the others stay."""
    by = F.when(moved, F.lit(shift)).otherwise(F.lit(0))
    return clips.withColumns({lo: F.col(lo) + by, hi: F.col(hi) + by})


def ripple_remove(clips: DataFrame, gone: Column, track: str = "track", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Remove clips and close their gaps: a clip moves left by the removed clips that ended before it on its track.

    Ends of removed clips and starts of the others are put in one order per track, so that a running sum
    gives every shift.
    """
    removed = clips.where(gone)
    ends = removed.select(track, F.col(hi).alias("__t"), F.lit(0).alias("__kind"), (F.col(hi) - F.col(lo)).alias("__size"), F.lit(None).cast(clips.schema).alias("__clip"))
    row = F.struct(*[F.col(c) for c in clips.columns])
    starts = clips.where(~gone).select(track, F.col(lo).alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__size"), row.alias("__clip"))
    order = Window.partitionBy(track).orderBy("__t", "__kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = ends.unionByName(starts).withColumn("__shift", F.sum("__size").over(order)).where("__kind = 1")
    return shifted.select("__clip.*", "__shift").withColumns({lo: F.col(lo) - F.col("__shift"), hi: F.col(hi) - F.col("__shift")}).drop("__shift")


def resolve_overlaps(clips: DataFrame, on: list[str], id_col: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, id, new_lo, new_hi): clips pushed right until none overlaps its predecessor; pushes carry on.

    Both a clip's end and its successor's start carry the shift so far, so that each pair adds its own overlap
    only: the shift is a running sum, and no array holds a track.
    """
    w = Window.partitionBy(*on).orderBy(lo, id_col)
    pushed = clips.withColumn("__over", F.greatest(F.lit(0), F.coalesce(F.lag(hi).over(w) - F.col(lo), F.lit(0))))
    pushed = pushed.withColumn("__shift", F.sum("__over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pushed.select(*on, id_col, (F.col(lo) + F.col("__shift")).alias("new_lo"), (F.col(hi) + F.col("__shift")).alias("new_hi"))


def split(clips: DataFrame, lo: str, hi: str, at: int) -> DataFrame:
    """Cut the clips that hold ``at`` in their inside into two rows (part 0 and 1)."""
    inside = (F.col(lo) < at) & (F.col(hi) > at)
    left = F.struct(F.lit(0).alias("part"), F.col(lo).alias("a"), F.when(inside, F.lit(at).cast("long")).otherwise(F.col(hi)).alias("b"))
    right = F.when(inside, F.struct(F.lit(1).alias("part"), F.lit(at).cast("long").alias("a"), F.col(hi).alias("b")))
    cut = clips.withColumn("__p", F.explode(F.array_compact(F.array(left, right))))
    return cut.withColumns({"part": F.col("__p.part"), lo: F.col("__p.a"), hi: F.col("__p.b")}).drop("__p")


def survivors(entries: DataFrame, on: list[str], newest_first: list[Column], size: str, capacity: int, most: int) -> DataFrame:
    """What a least-recently-used cache still holds: the newest entries that fit, with the bytes up to each."""
    w = Window.partitionBy(*on).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    ranked = entries.withColumns({"held": F.sum(size).over(w), "__n": F.count("*").over(w)})
    return ranked.where((F.col("held") <= capacity) & (F.col("__n") <= most)).drop("__n")


def latest(rows: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert by key. One partial aggregation, no sort of whole groups."""
    row = F.struct(*[F.col(c) for c in rows.columns if c not in on])
    return rows.groupBy(*on).agg(F.max_by(row, F.struct(*order)).alias("__r")).select(*on, "__r.*")


def replay(log: DataFrame, on: list[str], order: list[str], path: str, value: str, undone: int = 0, depth: int = 200) -> DataFrame:
    """State after the log's applied entries: per path the last write, without the last ``undone``, of the last ``depth`` kept."""
    back = Window.partitionBy(*on).orderBy(*[F.desc(c) for c in order])
    applied = log.withColumn("__back", F.row_number().over(back)).where((F.col("__back") > undone) & (F.col("__back") <= depth))
    return applied.groupBy(*on, path).agg(F.min_by(value, "__back").alias(value))


def map_diff(old: Column, new: Column) -> Column:
    """Patches (path, op, old_value, value) between two maps; null and missing are one."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))

    def patch(k: Column) -> Column:
        a, b = F.element_at(old, k), F.element_at(new, k)
        op = F.when(a.isNull(), "add").when(b.isNull(), "remove").otherwise("replace")
        return F.struct(k.alias("path"), op.alias("op"), a.alias("old_value"), b.alias("value"))

    return F.filter(F.transform(keys, patch), lambda p: ~p["old_value"].eqNullSafe(p["value"]))


def apply_patches(state: Column, patches: Column, undo: bool = False) -> Column:
    """A map after patches are applied, or taken back."""
    value = "old_value" if undo else "value"
    touched = F.transform(patches, lambda p: p["path"])
    rest = F.map_filter(state, lambda k, _: ~F.array_contains(touched, k))
    put = F.filter(patches, lambda p: p[value].isNotNull())
    return F.map_concat(rest, F.map_from_arrays(F.transform(put, lambda p: p["path"]), F.transform(put, lambda p: p[value])))


def switch_angles(switches: DataFrame, on: list[str], t: str, angle: str) -> DataFrame:
    """Cut list of a programme: (keys, angle, in_pt, out_pt); a switch to the live angle is none, the last cut is open."""
    w = Window.partitionBy(*on).orderBy(t)
    changed = switches.withColumn("__was", F.lag(angle).over(w)).where(F.col("__was").isNull() | (F.col("__was") != F.col(angle)))
    return changed.select(*on, angle, F.col(t).alias("in_pt"), F.lead(t).over(w).alias("out_pt"))
