"""Windows over runs and attempts, and the table of runs (A08, A09, A11, D13, T-S10, T-S11)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType, TimestampNTZType

from docketry.operators.ordering import number_in_groups
from docketry.session import stored

# fixed values: attempts allowed, and the length of a window
ALLOWED, WINDOW_SECONDS = 10, 900
#: Attempts of a key from which on it is split over tasks.
HOT_ATTEMPTS = 1_000_000
EPOCH = datetime(1970, 1, 1)


def daily_successes(health: DataFrame, late: str = "1 day") -> DataFrame:
    """Successes of each source and day, batch or stream; a stream closes a day once it is ``late`` behind."""
    day = F.window("run_timestamp", "1 day")
    out = health.withWatermark("run_timestamp", late) if health.isStreaming else health
    return out.groupBy("scraper_id", day.alias("w")).agg(F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes")).select("scraper_id", F.col("w.start").cast("date").alias("day"), "runs", "successes")


def run_rows(health: DataFrame) -> DataFrame:
    """A row of the run table for each health event; an event that was sent twice counts once.

    A failed run that captured something is ``partial``; what is unknown counts as a failure, and as no record.
    """
    rest = [F.col(c) for c in ("scraper_id", "run_timestamp", "success", "records_captured", "error_message", "response_time_seconds")]
    runs = health.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("run")).select("event_id", "run.*")
    captured = F.coalesce("records_captured", F.lit(0))
    status = F.when(F.col("success"), "success").when(captured > 0, "partial").otherwise("failure")
    elapsed = F.round(F.col("response_time_seconds") * 1000).cast("int").alias("response_time_ms")
    rows = runs.select(F.col("event_id").alias("id"), "scraper_id", F.col("run_timestamp").alias("started_at"), status.alias("status"), captured.alias("records_captured"), "error_message", elapsed)
    return rows.withColumn("completed_at", F.timestamp_add("MILLISECOND", F.col("response_time_ms"), F.col("started_at")))


def load_runs(batch: DataFrame, batch_id: int, base: str) -> None:
    """One micro-batch of health events into the run table at ``base``, for ``foreachBatch``; a replayed batch
    leaves what it left before."""
    run_rows(batch).write.mode("overwrite").parquet(f"{base}/bid={batch_id}")


def number_attempts(
    attempts: DataFrame, key: str, at: str, order: str, seconds: int = WINDOW_SECONDS, allowed: int = ALLOWED, hot: int = HOT_ATTEMPTS
) -> DataFrame:
    """Each attempt with its window's start, its number in the window and whether it is allowed.

    A window starts with a key's first attempt after the last window's end.  Keys with fewer than ``hot`` attempts are
    dealt to partitions, where their attempts stream through in order; the others are split over tasks
    (:func:`split_attempts`), with the same result.  Attempts without a key or a time are in no window and are left out.
    """
    known = attempts.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    many = stored(known.groupBy(key).count().where(F.col("count") >= hot).select(key), "hot-keys")
    if many.isEmpty():
        return _stream_attempts(known, key, at, order, seconds, allowed)
    few, heavy = known.join(many, key, "left_anti").select(attempts.columns), known.join(many, key, "left_semi").select(attempts.columns)
    return _stream_attempts(few, key, at, order, seconds, allowed).unionByName(split_attempts(heavy, key, at, order, seconds, allowed))


def window_starts(attempts: DataFrame, key: str, at: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``key, window_start``: where each key's windows start, without a task that has a whole key.

    A key's times are numbered; each points at the first time that is a window's length later.  That time's number
    comes from numbering times and window ends together: of an end's place, what isn't ends before it are
    times before it.  Pointers are then doubled, and what the first time reaches by them are the starts: as many
    rounds as the logarithm of the most windows of a key, each written to the shared folder.
    """
    times = stored(number_in_groups(attempts.select(key, at).distinct(), [key], [F.col(at)], "__rank"), "window-times")
    end = F.col(at) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    both = times.select(key, F.col(at).alias("__t"), F.lit(True).alias("__time"), "__rank")
    both = both.unionAll(times.select(key, end, F.lit(False), "__rank"))
    # an end that is a time as well comes first: the window that starts there is the next one
    placed = number_in_groups(both, [key], [F.col("__t"), F.col("__time")], "__place").where(~F.col("__time"))
    jumps = stored(placed.select(key, F.col("__rank").alias("__from"), (F.col("__place") - F.col("__rank") + 1).alias("__to")), "window-jumps")
    reached = times.where("__rank = 1").select(key, "__rank")
    while not jumps.isEmpty():
        further = reached.join(jumps.withColumnRenamed("__from", "__rank"), [key, "__rank"]).select(key, F.col("__to").alias("__rank"))
        reached = stored(reached.unionAll(further).distinct(), "window-reached")
        after = jumps.select(key, F.col("__from").alias("__to"), F.col("__to").alias("__then"))
        jumps = stored(jumps.join(after, [key, "__to"]).select(key, "__from", F.col("__then").alias("__to")), "window-jumps")
    return times.join(reached, [key, "__rank"]).select(key, F.col(at).alias("window_start"))


def split_attempts(attempts: DataFrame, key: str, at: str, order: str, seconds: int = WINDOW_SECONDS, allowed: int = ALLOWED) -> DataFrame:
    """:func:`number_attempts` for keys of any size: windows from :func:`window_starts`, numbers by sorted ranges.

    Starts of a key are a window's length apart at least, so a stretch of that length has one at most, and an
    attempt's window starts in its own stretch or the one before."""
    starts = stored(window_starts(attempts, key, at, seconds).select(key, F.col("window_start"), _stretch("window_start", attempts.schema[at].dataType, seconds).alias("__stretch")), "window-starts")
    own = starts.withColumnRenamed("window_start", "__own")
    last = starts.select(key, F.col("window_start").alias("__last"), (F.col("__stretch") + 1).alias("__stretch"))
    met = attempts.withColumn("__stretch", _stretch(at, attempts.schema[at].dataType, seconds)).join(own, [key, "__stretch"], "left").join(last, [key, "__stretch"], "left")
    start = F.when(F.col("__own") <= F.col(at), F.col("__own")).otherwise(F.col("__last"))
    met = met.select(*attempts.columns, start.alias("window_start"))
    out = number_in_groups(met, [key, "window_start"], [F.col(at), F.col(order)], "attempt")
    return out.withColumn("attempt", F.col("attempt").cast("int")).withColumn("ok", F.col("attempt") <= allowed)


def _stretch(at: str, kind: DataType, seconds: int) -> Column:
    """Which stretch of ``seconds`` a time falls into."""
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'" if isinstance(kind, TimestampNTZType) else "TIMESTAMP'1970-01-01 00:00:00Z'"
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, {epoch}, `{at}`)") / (seconds * 1_000_000))


def _stream_attempts(attempts: DataFrame, key: str, at: str, order: str, seconds: int, allowed: int) -> DataFrame:
    """A key's attempts in one task, in order; no group is held as a whole."""
    span = timedelta(seconds=seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start, n = object(), None, 0
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[at]):
                if k != who or t >= start + span:
                    who, start, n = k, t, 0
                n += 1
                rows.append((start, n, n <= allowed))
            yield batch.assign(**pd.DataFrame(rows, columns=["window_start", "attempt", "ok"], index=batch.index))

    kind = {f.name: f.dataType.simpleString() for f in attempts.schema}
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kind.items()), f"window_start {kind[at]}", "attempt int", "ok boolean"])
    return attempts.repartition(key).sortWithinPartitions(key, at, order).mapInPandas(run, schema)


def limit_stream(attempts: DataFrame, key: str, at: str, seconds: int = WINDOW_SECONDS, allowed: int = ALLOWED, late: str = "1 minute") -> DataFrame:
    """A11 on a stream: ``key, window_start, attempts, ok`` each time a key's window changes.

    State is one row a key and goes when the watermark, ``late`` behind the last attempt seen, passes the window's end;
    the next attempt then opens a window of its own, as it would have anyway."""
    span = timedelta(seconds=seconds)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        out = []
        for t in sorted(x for b in batches for x in b[at]):
            if start is None or t >= start + span:
                start, n = t, 0
            n += 1
            out.append((*k, start, n, n <= allowed))
        state.update((start, n))
        # a window that the watermark has passed already goes with the next batch
        end = int(((start + span) - EPOCH).total_seconds() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "window_start", "attempts", "ok"])

    kind = {f.name: f.dataType.simpleString() for f in attempts.schema}
    schema = f"`{key}` {kind[key]}, window_start {kind[at]}, attempts int, ok boolean"
    keyed = attempts.withWatermark(at, late).groupBy(key)
    return keyed.applyInPandasWithState(run, schema, f"start {kind[at]}, n int", "append", GroupStateTimeout.EventTimeTimeout)
