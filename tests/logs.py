"""Small logs in the canonical columns."""

from workfold import model as M


def measure(name, value, unit="BYTES", kind="PEAK", method="cgroup.job.resident"):
    return (name, value, unit, kind, method)


def event(kind, handle, ts, attempt=0, task="t", status="OK", mem=0, flags=0, measures=None, tail=None, arrival=None, shard=None):
    return (kind, handle, task, ts, status, attempt, mem, flags, measures, tail, None, arrival, shard)


def lifecycle(spark, events):
    """Events in arrival order."""
    from decimal import Decimal

    rows = []
    for i, e in enumerate(events):
        e = list(e)
        e[8] = None if e[8] is None else [(m[0], Decimal(m[1]), *m[2:]) for m in e[8]]
        e[11] = i if e[11] is None else e[11]
        rows.append(tuple(e))
    return spark.createDataFrame(rows, M.LIFECYCLE)


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
