"""Operators over the order of a session: gaps, velocities, sliding frames, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.anatomy import JITTER_POINTS
from kinetable.config import Config
from kinetable.operators.ordered import (
    SLICE,
    Timeline,
    dense_window,
    home_rows,
    previous,
    row_index,
    running,
    spread,
    with_halo,
)
from kinetable.session import staged


def timeline(cfg: Config, key=("session_id",), order=("t", "frame_idx")) -> Timeline:
    """The usual order of frames: by time, ties by frame number, in slices of ``cfg.slice_s``."""
    return Timeline(tuple(key), tuple(order), cfg.span(cfg.slice_s))


def frame_gaps(df: DataFrame, cfg: Config, line: Timeline | None = None) -> DataFrame:
    """Add ``dt`` (time since the previous row, floored), and ``is_gap``; both unset on the first row."""
    line = line or timeline(cfg)
    t = line.order[0]
    out = previous(df, line, {"_t0": F.col(t)})
    return out.select(*df.columns, *gap_columns(F.col(t), F.col("_t0"), cfg))


def gap_columns(t: Column, before: Column, cfg: Config) -> list[Column]:
    """``dt`` and ``is_gap`` from the time of a row and of the row before it."""
    delta = t - before
    return [
        F.when(before.isNotNull(), F.greatest(delta, F.lit(cfg.span(1e-4)))).alias("dt"),
        F.coalesce(delta > F.lit(cfg.span(cfg.gap_s)), F.lit(False)).alias("is_gap"),
    ]


def point_distance(a: Column, b: Column, point: int) -> Column:
    """2-D distance of one landmark between two flat x,y,z arrays."""
    dx = a[point * 3] - b[point * 3]
    dy = a[point * 3 + 1] - b[point * 3 + 1]
    return F.sqrt(dx * dx + dy * dy)


def jitter(df: DataFrame, cfg: Config, landmarks: str = "landmarks", points=JITTER_POINTS, line: Timeline | None = None) -> DataFrame:
    """Add ``jitter``: mean landmark displacement per second since the previous row, 0 on the first."""
    line = line or timeline(cfg)
    t = line.order[0]
    # Only the few coordinates that are read travel through the shuffle twice.
    kept = F.array(*[F.col(landmarks)[p * 3 + axis] for p in points for axis in (0, 1)])
    out = previous(df.withColumn("_now", kept), line, {"_t0": F.col(t), "_then": F.col("_now")})
    total = None
    for i in range(len(points)):
        dx = F.col("_now")[2 * i] - F.col("_then")[2 * i]
        dy = F.col("_now")[2 * i + 1] - F.col("_then")[2 * i + 1]
        step = F.sqrt(dx * dx + dy * dy)
        total = step if total is None else total + step
    dt = F.greatest(F.lit(1e-4), (F.col(t) - F.col("_t0")) / F.lit(cfg.unit))
    return out.select(*df.columns, F.coalesce(total / len(points) / dt, F.lit(0.0)).alias("jitter"))


def velocity(df: DataFrame, cfg: Config, value: str = "mouth", name: str = "velocity", line: Timeline | None = None) -> DataFrame:
    """Add absolute change per second; 0 on the first row and where time stands still."""
    line = line or timeline(cfg)
    t = line.order[0]
    out = previous(df, line, {"_t0": F.col(t), "_v0": F.col(value)})
    dt = (F.col(t) - F.col("_t0")) / F.lit(cfg.unit)
    speed = F.when(dt > 1e-4, F.abs(F.col(value) - F.col("_v0")) / dt).otherwise(F.lit(0.0))
    return out.select(*df.columns, speed.alias(name))


def mouth_window(df: DataFrame, cfg: Config, value: str = "mouth", speed: str = "velocity", line: Timeline | None = None) -> DataFrame:
    """Mean speed, range and peak over the last 0.4 s, at most the last 30 rows."""
    line = line or timeline(cfg)
    t = line.order[0]
    reach = cfg.span(cfg.lip_window_s)
    # Rows that can matter lie within the time reach, so a time halo is complete.
    data = with_halo(df, F.col(t), line.width, before=reach)
    frame = Window.partitionBy(*line.key, SLICE).orderBy(*line.order).rowsBetween(-(cfg.lip_window_rows - 1), 0)
    data = data.withColumn(
        "_recent",
        F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("y"), F.col(speed).alias("v"))).over(frame),
    )
    data = home_rows(data)
    data = data.withColumn("_recent", F.filter("_recent", lambda r: F.col(t) - r["t"] <= F.lit(reach)))
    ys = F.transform("_recent", lambda r: r["y"])
    total = F.aggregate("_recent", F.lit(0.0), lambda acc, r: acc + r["v"])
    size = F.size("_recent")
    return data.select(
        *df.columns,
        (total / size).alias("mean_velocity"),
        F.when(size >= 2, F.array_max(ys) - F.array_min(ys)).otherwise(F.lit(0.0)).alias("mouth_range"),
        F.array_max(ys).alias("mouth_peak"),
    )


def articulation(df: DataFrame, cfg: Config) -> DataFrame:
    """Flag articulating rows and score the motion, from :func:`mouth_window` columns."""
    moving = (
        (F.col("mean_velocity") >= cfg.lip_velocity)
        & (F.col("mouth_range") >= cfg.lip_range)
        & (F.col("mouth_peak") >= cfg.lip_peak)
    )
    score = F.least(F.lit(1.0), F.col("mean_velocity") / F.lit(max(1e-4, cfg.lip_velocity * 2.2)))
    return df.withColumn("articulating", moving).withColumn("motion_score", score)


def hit_count(df: DataFrame, cfg: Config, key=("session_id", "face_id"), name: str = "hits", line: Timeline | None = None) -> DataFrame:
    """Running number of observations of a track."""
    line = line or timeline(cfg, key=key)
    return running(df, line, {name: ("sum", F.lit(1).cast("long"))})


def primary_score(area: Column, cx: Column, cy: Column, hits: Column) -> Column:
    centre = F.sqrt((cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5))
    return area * 0.5 + F.greatest(F.lit(0.0), 1.0 - centre / 0.707) * 0.3 + F.least(hits, F.lit(30)) / 30.0 * 0.2


def primary_face(df: DataFrame, frame=("session_id", "frame_idx"), order: str = "det_idx") -> DataFrame:
    """Add ``is_primary``: the best-scoring face of each frame, the first one on a tie.

    The best face is an aggregate with map-side partials, not a sort of the frame.
    """
    scored = df.withColumn("score", primary_score(F.col("area"), F.col("cx"), F.col("cy"), F.col("hits")))
    best = scored.groupBy(*frame).agg(F.max(F.struct("score", (-F.col(order)).alias("o"))).alias("_best"))
    return scored.join(best, list(frame)).select(
        *df.columns, "score", (-F.col("_best.o") == F.col(order)).alias("is_primary")
    )


def monotonic_ms(df: DataFrame, cfg: Config, line: Timeline | None = None, name: str = "ts_ms") -> DataFrame:
    """Strictly increasing milliseconds: ``max(previous + 1, rounded time)``.

    Subtracting the row index turns the recursion into a running maximum.
    """
    line = line or timeline(cfg)
    ms = F.bround(F.col(line.order[0]) / F.lit(cfg.unit) * 1000).cast("long")
    indexed = staged(row_index(df, line, "_i"))
    out = running(indexed, line, {"_lead": ("max", ms - F.col("_i"))})
    return out.select(*df.columns, (F.col("_i") + F.greatest(F.lit(0), F.col("_lead"))).alias(name))


def lag_features(df: DataFrame, line: Timeline, energy: str, prob: str, width: int = 100_000, name: str = "features") -> DataFrame:
    """64 values per row: energy and probability now and at lags 1 to 15, the rest 0."""
    data, window = dense_window(df, line, width, before=15)
    cols = []
    for lag in range(16):
        for source in (energy, prob):
            cols.append(F.lag(source, lag, 0.0).over(window) if lag else F.col(source).cast("double"))
    cols += [F.lit(0.0)] * (64 - len(cols))
    return home_rows(data.withColumn(name, F.array(*cols)), "_idx")


def with_size(df: DataFrame, line: Timeline) -> DataFrame:
    """Rows with their position ``_i`` in their key and the key's number of rows ``_n``."""
    indexed = staged(row_index(df, line, "_i"))
    sizes = indexed.groupBy(*line.key).agg((F.max("_i") + 1).alias("_n"))
    return spread(indexed, line, sizes) if line.key else indexed.crossJoin(F.broadcast(sizes))  # one row


def sequence_windows(
    df: DataFrame, line: Timeline, payload: Column, length: int = 64, stride: int = 16, drop_short: bool = False
) -> DataFrame:
    """Overlapping fixed-length sequences per key: ``seq``, ``n_rows``, ``rows`` in order.

    There are ``max(1, (n - length) // stride)`` sequences of a key with n rows.
    Each row is copied at most ``length / stride`` times, and a group never holds
    more than ``length`` rows.
    """
    key = list(line.key)
    indexed = with_size(df, line)
    count = F.greatest(F.lit(1), F.floor((F.col("_n") - length) / stride)).cast("long")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (length - 1)) / stride)).cast("long")
    last = F.floor(F.col("_i") / stride).cast("long")
    copies = F.filter(F.sequence(first, last), lambda s: s < count)
    exploded = indexed.filter(first <= last).select(
        *key, F.explode(copies).alias("seq"), F.struct(F.col("_i").alias("i"), payload.alias("v")).alias("_p")
    )
    out = exploded.groupBy(*key, "seq").agg(F.array_sort(F.collect_list("_p")).alias("_rows"))
    out = out.select(
        *key, "seq", F.size("_rows").alias("n_rows"), F.transform("_rows", lambda r: r["v"]).alias("rows")
    )
    return out.filter(F.col("n_rows") == length) if drop_short else out


def best_segment(df: DataFrame, line: Timeline, value: str, length: int, step: int = 30, width: int = 100_000) -> DataFrame:
    """Start and sum of the first best window of ``length`` rows, starts every ``step`` rows.

    As in the reference search, a start is tried only while a full window and one
    more row remain, and a non-positive best keeps start 0.
    """
    key = list(line.key)
    data, window = dense_window(df, line, max(width, length), after=length)
    frame = window.rowsBetween(0, length - 1)
    sums = data.withColumn("_sum", F.sum(value).over(frame)).filter(F.col("_home") & (F.col("_idx") % step == 0))
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.join(sizes, key) if key else sums.crossJoin(F.broadcast(sizes))
    tried = (F.col("_idx") < F.col("_n") - length) & (F.col("_sum") > 0)
    best = F.max(F.when(tried, F.struct(F.col("_sum").alias("s"), (-F.col("_idx")).alias("i"))))
    out = sums.groupBy(*key).agg(best.alias("_b"))
    return out.select(
        *key,
        F.coalesce(-F.col("_b.i"), F.lit(0)).cast("long").alias("start"),
        F.col("_b.s").alias("segment_sum"),
    )


def differences(df: DataFrame, line: Timeline, value: str, width: int = 100_000) -> DataFrame:
    """First and second differences (null where not enough rows precede)."""
    data, window = dense_window(df, line, width, before=2)
    back1, back2 = F.lag(value, 1).over(window), F.lag(value, 2).over(window)
    data = data.withColumn("diff1", F.col(value) - back1).withColumn(
        "diff2", (F.col(value) - back1) - (back1 - back2)
    )
    return home_rows(data, "_idx")


def round_robin(df: DataFrame, parts: int, line: Timeline, name: str = "part") -> DataFrame:
    """Deal rows in global order to ``parts`` disjoint lists."""
    return row_index(df, line, "_i").withColumn(name, F.col("_i") % parts).drop("_i")


def tail_split(df: DataFrame, line: Timeline, train_share: float = 0.85) -> DataFrame:
    """First share of rows by position is training, the rest validation."""
    out = with_size(df, line)
    return out.select(*df.columns, (F.col("_i") < F.floor(F.col("_n") * train_share)).alias("is_train"))


def throughput(df: DataFrame, key: list[str], t: str, latency: str, cfg: Config, n: int = 60) -> DataFrame:
    """Capture rate and mean latency over the last ``n`` events of each key.

    The rank filter becomes a limit per key inside every input task, so at most n
    rows per key and task are shuffled however large a key is.
    """
    newest = Window.partitionBy(*key).orderBy(F.desc(t))
    last = df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    rows = last.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(t) - F.min(t)).alias("_span"),
        F.avg(latency).alias("avg_latency"),
    )
    seconds = F.col("_span") / F.lit(cfg.unit)
    return rows.select(
        *key,
        "n",
        F.when((F.col("n") >= 2) & (seconds > 0), (F.col("n") - 1) / seconds).otherwise(F.lit(0.0)).alias("capture_fps"),
        "avg_latency",
        F.when(F.col("avg_latency") > 0, F.lit(1000.0) / F.col("avg_latency")).otherwise(F.lit(0.0)).alias("inference_fps"),
    )


def watch_sessions(df: DataFrame, cfg: Config, trigger: Column, keep: Column, line: Timeline | None = None, rearm: bool = False) -> DataFrame:
    """One recording per session: first trigger after a steady run, then first loss.

    ``start``: first row that ends a run of trigger-usable rows lasting 0.30 s.
    ``stop``: first later row at least 1.80 s after the last keep-usable row; null
    if the session ends first.  Session-level results are partial aggregates.
    With ``rearm`` the watch begins anew after each loss, see :func:`watch_again`.
    """
    line = line or timeline(cfg)
    if rearm:
        return watch_again(df, cfg, trigger, keep, line)
    t = line.order[0]
    key = list(line.key)
    base = df.select(*line.key, *line.order, trigger.alias("_on"), keep.alias("_keep"))
    data = staged(previous(base, line, {"_was": F.col("_on")}))
    starts = F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False))
    data = running(data, line, {"_run": ("max", F.when(starts, F.col(t)))})
    armed = F.col("_on") & (F.col(t) - F.col("_run") >= F.lit(cfg.span(cfg.watch_trigger_s)))
    first = data.filter(armed).groupBy(*key).agg(F.min(line.position()).alias("_start"))
    first = staged(first)
    after = staged(spread(base, line, first).filter(line.position() > F.col("_start")))
    after = running(after, line, {"_seen": ("max", F.when(F.col("_keep"), F.col(t)))})
    last_seen = F.greatest(F.col("_seen"), F.col("_start")[t])
    lost = ~F.col("_keep") & (F.col(t) - last_seen >= F.lit(cfg.span(cfg.watch_loss_s)))
    ends = after.filter(lost).groupBy(*key).agg(F.min(line.position()).alias("_stop"))
    return first.join(ends, key, "left").select(
        *key, F.col("_start")[t].alias("start"), F.col("_stop")[t].alias("stop")
    )


def watch_again(df: DataFrame, cfg: Config, trigger: Column, keep: Column, line: Timeline) -> DataFrame:
    """Every recording of a session: key, ``recording`` (from 1), ``start`` and ``stop``.

    A row is a transition function of the automaton armed/recording: a run of trigger rows sets
    it to recording whatever it was, a loss sets it to armed, other rows leave it alone.  Such
    functions compose to the newest one that sets anything, so the composition of all earlier
    rows is a running maximum, which slices hand on like any other; no session is one task.
    A row counts as a trigger only if it is keep-usable as well: the face that starts a
    recording is there.  So no run of triggers reaches over a loss.
    """
    t, key, place = line.order[0], list(line.key), line.position()
    on = F.coalesce(trigger & keep, F.lit(False))
    base = df.select(*key, *line.order, on.alias("_on"), F.coalesce(keep, F.lit(False)).alias("_keep"))
    data = staged(previous(base, line, {"_was": F.col("_on")}))
    starts = F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False))
    # The start of the running run of triggers, and the newest keep-usable row.
    data = running(data, line, {"_run": ("max", F.when(starts, F.col(t))), "_seen": ("max", F.when(F.col("_keep"), F.col(t)))})
    up = F.col("_on") & (F.col(t) - F.col("_run") >= F.lit(cfg.span(cfg.watch_trigger_s)))
    down = ~F.col("_keep") & (F.col(t) - F.col("_seen") >= F.lit(cfg.span(cfg.watch_loss_s)))
    setting = staged(data.withColumn("_set", F.when(up, True).when(down, False)).filter("_set is not null").select(*key, *line.order, "_set"))
    before = previous(setting, line, {"_state": F.col("_set")})
    changes = staged(before.filter(F.col("_set") != F.coalesce("_state", F.lit(False))))
    opened = running(changes, line, {"_start": ("max", F.when(F.col("_set"), place)), "recording": ("sum", F.col("_set").cast("long"))})
    out = opened.groupBy(*key, "recording").agg(F.max(F.col("_start")[t]).alias("start"), F.min(F.when(~F.col("_set"), F.col(t))).alias("stop"))
    return out.select(*key, "recording", "start", "stop")


def pre_roll(df: DataFrame, triggers: DataFrame, cfg: Config, line: Timeline | None = None, at: str = "start") -> DataFrame:
    """Rows within 2 s before each session's trigger, at most ``max(10, 2 s of frames)`` of them."""
    line = line or timeline(cfg)
    t = line.order[0]
    cap = max(10, int(cfg.preroll_s * cfg.fps))
    near = spread(df, line, triggers.select(*line.key, F.col(at).alias("_at"))).filter(
        (F.col(t) <= F.col("_at")) & (F.col(t) >= F.col("_at") - F.lit(cfg.span(cfg.preroll_s)))
    )
    newest = Window.partitionBy(*line.key).orderBy(*[F.desc(c) for c in line.order])
    return near.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= cap).select(*df.columns)


def cap_session(df: DataFrame, cfg: Config, seconds: Column, max_s: float | None, max_frames: int | None, line: Timeline | None = None) -> DataFrame:
    """Rows of a session until the accumulated duration or the frame count reaches its cap."""
    line = line or timeline(cfg)
    out = running(
        df,
        line,
        {"_used": ("sum", seconds), "_taken": ("sum", F.lit(1).cast("long"))},
        inclusive=False,
    )
    keep = F.lit(True)
    if max_s is not None:
        keep = keep & (F.coalesce(F.col("_used"), F.lit(0)) < F.lit(max_s))
    if max_frames is not None:
        keep = keep & (F.coalesce(F.col("_taken"), F.lit(0)) < F.lit(max_frames))
    return out.filter(keep).select(*df.columns)
