"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks.  With weight W of D slots, block i of a source may start at slot floor(i*D/W)
and must be done by slot ceil((i+1)*D/W); earliest deadline first then keeps every source within less than one block of
its share after every slot.  Weights are whole numbers that sum to D, so the schedule repeats after D slots: one period is
worked out, which depends on the weights alone and not on the data, and every block finds its slot from it by arithmetic.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.sharding import numbered

OTHER = "\u0000other"


def whole_weights(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole numbers that sum to ``slots``, at least one for each positive weight, by largest remainders."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        return {}
    if len(weights) > slots:
        raise ValueError("more sources than slots")
    total = sum(weights.values())
    exact = {s: w * slots / total for s, w in weights.items()}
    found = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    while (left := slots - sum(found.values())) != 0:
        for s in order if left > 0 else sorted(found, key=lambda s: (exact[s] - found[s], s)):
            if left == 0:
                break
            if left > 0:
                found[s], left = found[s] + 1, left - 1
            elif found[s] > 1:
                found[s], left = found[s] - 1, left + 1
    return found


def period(weights: dict[str, int]) -> list[str]:
    """The sources of one period's slots: earliest deadline first among released blocks."""
    slots = sum(weights.values())
    waiting = [(0, -(-slots // w), s, 0) for s, w in sorted(weights.items())]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for now in range(slots):
        while waiting and waiting[0][0] <= now:
            _, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= now:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * slots // weights[s], -(-(i + 2) * slots // weights[s]), s, i + 1))
    return out


def tempered(counts: dict[str, int], power: float) -> dict[str, float]:
    return {s: float(n) ** power for s, n in counts.items()}


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.7,
    most_sources: int = 4_096,
    slots: int = 20_000,
    block: int = 16,
) -> DataFrame:
    """``docs`` with ``mix_group, mix_block, mix_slot, mix_position, in_target``.

    ``weights`` names target shares; without it sources get their row counts to the ``power`` as weights.  A schedule has
    a period of ``slots`` and holds ``most_sources`` at most, which bounds what the driver works out: a share is a whole
    number of slots, and where there are more sources the smallest form one group with one share.  A source that
    ``weights`` does not name is in that group too, with no share.  Rows enter blocks in the order of a hash of doc_id and,
    where that is null, of the source.  Every row of a group with a share gets a position; ``in_target`` is true for the
    rows before the first slot whose source has no block left, up to where the mix has its target weights.  Afterwards
    the sources that are left keep their order and their relative shares.  Rows of a group without a share have no
    position and come after all others.

    A null source is a source of its own; null texts do not matter; repeated rows get positions of their own; an
    empty table gives no rows.  Added columns replace columns of the same name; all other columns stay as they are, except
    that names that begin with ``_mix_`` or ``_of_`` are kept for inner use.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_group", "mix_block", "mix_slot", "mix_position", "in_target")
    source = F.coalesce(F.col("source").cast("string"), F.lit("\u0000null"))
    by_source = docs.groupBy(source.alias("s")).count()
    if weights is None:
        largest = by_source.orderBy(F.desc("count"), "s").limit(most_sources)
        counts = {r["s"]: r["count"] for r in largest.collect()}  # at most most_sources rows
        rest = (by_source.agg(F.sum("count")).first()[0] or 0) - sum(counts.values())
        weights = tempered(counts | ({OTHER: rest} if rest else {}), power)
        counts[OTHER] = rest
    else:
        named = {r["s"]: r["count"] for r in by_source.where(F.col("s").isin(list(weights))).collect()}  # those that weights names
        counts = {s: named.get(s, 0) for s in weights}
    share = whole_weights({s: w for s, w in weights.items() if counts.get(s)}, slots)
    plan, seen = [], dict.fromkeys(share, 0)
    for slot, s in enumerate(period(share)):
        plan.append((s, seen[s], slot))
        seen[s] += 1
    of = {(s, i): slot for s, i, slot in plan}
    used = sum(share.values())
    end = min((n // share[s] * used + of[s, n % share[s]] for s in share for n in [-(-counts[s] // block)]), default=0)
    number = {s: k for k, s in enumerate(sorted(weights))}
    groups = spark.createDataFrame([(s, s, k, share.get(s)) for s, k in number.items()], "_mix_source string, mix_group string, _mix_number int, _mix_share int")
    other = F.lit(number.get(OTHER, -1))
    schedule = spark.createDataFrame([(number[s], i, slot) for s, i, slot in plan], "_mix_number int, _mix_turn long, _mix_at int")
    rows = docs.withColumn("_mix_source", source).join(F.broadcast(groups), "_mix_source", "left")  # a row a source of the schedule
    rows = rows.withColumns({
        "mix_group": F.coalesce("mix_group", F.lit(OTHER)),
        "_mix_number": F.coalesce("_mix_number", other),
        "_mix_share": F.coalesce("_mix_share", F.lit(share.get(OTHER, 1))),
        "_mix_key": F.xxhash64("doc_id", "_mix_source"),
    })
    rows = numbered(rows, "_mix_number", ["_mix_key", "doc_id"], "_mix_row")
    rows = rows.withColumn("mix_block", F.expr(f"_mix_row DIV {block}")).withColumn("_mix_turn", F.col("mix_block") % F.col("_mix_share"))
    rows = rows.join(F.broadcast(schedule), ["_mix_number", "_mix_turn"], "left")  # a row a slot of the period
    rows = rows.withColumn("mix_slot", F.expr(f"mix_block DIV _mix_share * {used} + _mix_at"))
    rows = rows.withColumn("mix_position", F.col("mix_slot") * block + F.col("_mix_row") % block)
    rows = rows.withColumn("in_target", F.coalesce(F.col("mix_slot") < end, F.lit(False)))
    return rows.select(*docs.columns, "mix_group", "mix_block", "mix_slot", "mix_position", "in_target")
