"""Subscriptions to some keys of a change log: what of them is new between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.changelog import ChangeLog
from ..operators.library import apart


def changed(log: ChangeLog, since: int, until: int | None = None) -> DataFrame:
    """Keys whose row in force is another at version `until` than at `since`, with `change` (added, changed, removed) and
    the row's values at `until`. Keys that were written again with the same values, and order, are not among them.

    Only keys that batches in between have are compared, so work follows the changes, but for the join's look into both
    states, which reads files by bucket.
    """
    until = log.version()[0] if until is None else until
    keys = log.changes(since, until).select(*log.key).distinct()
    now = log.state(until).join(keys, log.key, "left_semi")
    values = [c for c in now.columns if c not in log.key and c not in log.order]
    if not since:
        return now.withColumn(apart(now, "change"), F.lit("added"))
    was = log.state(since).join(keys, log.key, "left_semi")
    old, new, change = apart(now, "old"), apart(now, "new"), apart(now, "change")
    pack = lambda df, name: df.select(*log.key, F.struct(*[c for c in now.columns if c in df.columns and c not in log.key]).alias(name))
    both = pack(now, new).join(pack(was, old), log.key, "full")
    same = F.lit(True)
    for c in values:
        same &= F.col(new)[c].eqNullSafe(F.col(old)[c]) if c in was.columns else F.col(new)[c].isNull()
    kind = F.when(F.col(old).isNull(), "added").when(F.col(new).isNull(), "removed").when(~same, "changed")
    out = both.withColumn(change, kind).where(F.col(change).isNotNull())
    return out.select(*log.key, *[F.col(new)[c].alias(c) for c in now.columns if c not in log.key], change)


def notified(changes: DataFrame, subscriptions: DataFrame, key: list[str]) -> DataFrame:
    """Changes for each subscriber (subscriber, key columns), of the keys subscribed to alone; who subscribes to a key
    twice hears of it once."""
    return changes.join(subscriptions.select("subscriber", *key).distinct(), key)
