"""Sequence operators: recurrences as running maxima, hopping windows, and ordered folds where a bound makes them greedy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import scalars as s
from parley.operators.carried import fold


def ocr_lines(hits: DataFrame, threshold: float = 0.75, exact: bool = False, key: str = "video_id") -> DataFrame:
    """Group recognised texts (key, ts, text): a new line starts where the text is less than ``threshold`` like the one before.

    The line's text is its first longest, its span the first and last time. There is no limit on the time between hits.
    With ``exact`` only equal texts (white space aside, not empty) are alike, and no Python runs.
    """
    order = Window.partitionBy(key).orderBy("ts", "pos")
    marked = hits.withColumn("prev", F.lag("text").over(order)).withColumn("first", F.row_number().over(order) == 1)
    a, b = s.squeeze(F.coalesce("prev", F.lit(""))), s.squeeze(F.col("text"))
    like = (a == b) & (a != "") if exact else s.similarity(F.col("prev"), F.col("text"), threshold) >= threshold
    groups = marked.withColumn("new", F.when(F.col("first") | ~like, 1).otherwise(0)).withColumn("line", F.sum("new").over(order))
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("pos")))
    return groups.groupBy(key, "line").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), longest.alias("text"), F.count(F.lit(1)).alias("hits"))


def monotone_lines(lines: DataFrame, half: int = 250, gap: int = 10, least: int = 300, key: str = "video_id") -> DataFrame:
    """Widen lines (key, line, first_ts, last_ts) by ``half`` and clamp them: no start before the last end + ``gap``, none shorter than ``least``.

    The recurrence is one running maximum: with i the line's number, the end is (gap + least) i + running max of its own end less that.
    """
    order = Window.partitionBy(key).orderBy("line")
    step = gap + least
    own = F.greatest(F.col("last_ts") + half, F.greatest(F.lit(0), F.col("first_ts") - half) + least)
    numbered = lines.withColumn("i", F.row_number().over(order)).withColumn("m", own - step * F.col("i"))
    ended = numbered.withColumn("t1", step * F.col("i") + F.greatest(F.lit(0), F.max("m").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return ended.withColumn("t0", F.greatest(F.lit(0), F.col("first_ts") - half, F.coalesce(F.lag("t1").over(order), F.lit(0)) + gap)).drop("i", "m")


def clean_lines(hits: DataFrame, exact: bool = False, half: int = 250, gap: int = 10, least: int = 300, key: str = "video_id") -> DataFrame:
    """Subtitle lines of recognised texts: grouped, freed of badges, clamped. Groups that a badge alone made go, and their numbers stay holes."""
    cleaned = ocr_lines(hits, exact=exact, key=key).withColumn("text", s.clean_badge(F.col("text"))).filter("text <> ''")
    return monotone_lines(cleaned, half, gap, least, key).select(key, F.col("line").alias("idx"), "t0", "t1", "text")


def _kinds(rows: DataFrame, *columns: str) -> str:
    """Columns as they are, for the schema of a fold."""
    kinds = dict(rows.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def _join_units(gap: int, most: int):
    """Steps of ``merge_units``: the state is the open unit."""

    def step(unit: dict, x: dict):
        if unit and unit["spk"] == x["spk"] and x["t0"] - unit["t1"] <= gap and len(unit["text"]) + len(x["clean"]) <= most:
            unit["text"] += ("" if unit["text"][-1:] in ("。", ",", "?", "!") else ",") + x["clean"]
            unit["t1"] = x["t1"]
            return
        yield from _unit(unit)
        unit.clear()
        unit.update(idx=x["idx"], t0=x["t0"], t1=x["t1"], spk=x["spk"], text=x["clean"])

    return step


def _unit(unit: dict):
    if unit:
        yield unit["idx"], unit["t0"], unit["t1"], unit["spk"], unit["text"]


def merge_units(lines: DataFrame, gap: int = 600, most: int = 45, key: str = "video_id") -> DataFrame:
    """Join tagged lines (key, idx, t0, t1, text) of one speaker into units: gap at most ``gap``, at most ``most`` characters without the joiner.

    The joiner is a comma unless the text so far ends with ``。``, ``,``, ``?`` or ``!``. A carried scan of each video, which holds the open unit.
    """
    clean = lines.select(key, F.col("idx").cast("long").alias("idx"), "t0", "t1", s.speaker_tag(F.col("text")).alias("spk"), s.dub_text(F.col("text")).alias("clean")).filter("clean <> ''")
    return fold(clean, [key], ["idx"], f"{_kinds(clean, key)}, idx long, t0 long, t1 long, spk string, text string", dict, _join_units(gap, most), _unit)


#: Decimals of a tempo.
TEMPO = 4


def dub_plan(lines: DataFrame, gap: int = 50, borrow: float = 0.5, preferred: float = 1.15, cap: float = 2.0, key: str = "video_id") -> DataFrame:
    """Window end, tempo and mode of each line (key, idx, t0, t1, wav_dur): fit, borrow silence from the gap, or speed up (atempo).

    The next line is the next of the list, whether or not it has audio; lines without audio get no plan. A next start of 0
    counts as none, so the gap is unlimited. Beyond the preferred tempo what was borrowed is given back; the tempo is rounded to
    ``TEMPO`` places, and ``over`` tells of a sped-up line whose rounded tempo is still beyond the preferred one.
    """
    nxt = F.lead("t0").over(Window.partitionBy(key).orderBy("idx"))
    win = F.col("t1") - F.col("t0")
    space = F.when(F.coalesce(F.col("next_t0"), F.lit(0)) == 0, F.lit(10**12)).otherwise(F.col("next_t0") - gap - F.col("t1"))
    df = lines.withColumn("next_t0", nxt).filter("wav_dur IS NOT NULL").withColumn("win", win).withColumn("lent", F.least(F.greatest(F.lit(0), space).cast("double"), F.col("win") * borrow))
    fits, wide = F.col("wav_dur") <= F.col("win"), F.col("win") + F.col("lent")
    need = F.col("wav_dur") / wide
    plan = df.select(
        key,
        "idx",
        F.when(fits, F.col("t1").cast("double")).when((F.col("wav_dur") <= wide) | (need <= preferred), F.col("t1") + F.col("lent")).otherwise(F.col("t1").cast("double")).alias("win_end"),
        # the scaled binary value is rounded, as SQL does: F.round with places rounds the shortest decimal text, which ends in 5 where the value is under the half
        (F.round(F.when(fits | (F.col("wav_dur") <= wide), F.lit(1.0)).when(need <= preferred, need).otherwise(F.least(F.lit(cap), F.col("wav_dur") / F.col("win"))) * 10.0**TEMPO) / 10.0**TEMPO).alias("tempo"),
        F.when(fits, "fit").when(F.col("wav_dur") <= wide, "borrow").otherwise("atempo").alias("mode"),
    )
    return plan.withColumn("over", (F.col("mode") == "atempo") & (F.col("tempo") > preferred))


def mode_counts(plan: DataFrame) -> DataFrame:
    """How many lines have each mode, and as ``atempo_over`` how many of the sped-up ones are over; each of the four has a row."""
    n = [F.struct(F.lit(m).alias("mode"), F.count_if(F.col("mode") == m).alias("n")) for m in ("fit", "borrow", "atempo")]
    return plan.agg(F.array(*n, F.struct(F.lit("atempo_over").alias("mode"), F.count_if("over").alias("n"))).alias("x")).select(F.inline("x"))


def place_track(lines: DataFrame, gap: int = 50, key: str = "video_id") -> DataFrame:
    """Where each line's audio starts (key, idx, t0, wav_dur): never before the last one's end + ``gap``; missing audio does not count."""
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.filter("wav_dur IS NOT NULL").withColumn("d", F.sum(F.col("wav_dur") + gap).over(order))
    ended = df.withColumn("end_t", F.col("d") + F.greatest(F.lit(0), F.max(F.col("t0") + F.col("wav_dur") - F.col("d")).over(order)))
    return ended.withColumn("place_t", F.col("end_t") - F.col("wav_dur")).drop("d")


def trim_silence(samples: Column, quiet: int = 300, least: int = 800) -> Column:
    """Samples from the first to the last of ``quiet`` or louder; all of them if fewer than ``least`` would stay."""
    loud = F.transform(samples, lambda x: F.abs(x) >= quiet)
    first = F.array_position(loud, True)
    count = F.size(samples) - F.array_position(F.reverse(loud), True) + 2 - first
    return F.when((first > 0) & (count >= least), F.slice(samples, first.cast("int"), count.cast("int"))).otherwise(samples)


def trimmed(lines: DataFrame, rate: int, quiet: int = 300, least: int = 800) -> DataFrame:
    """Lines (…, samples) with the length of their audio once its silent ends are cut, in whole milliseconds, as ``wav_dur``; no samples, no audio."""
    return lines.withColumn("wav_dur", F.when(F.size("samples") > 0, F.floor(F.size(trim_silence(F.col("samples"), quiet, least)) * 1000 / rate).cast("long"))).drop("samples")


def render_track(lines: DataFrame, gap: int = 50, key: str = "video_id") -> DataFrame:
    """Plan and place of each line's audio as it is heard: sped up by the plan's tempo if that is over 1.001, then placed by its new length.

    Lengths are whole milliseconds. Lines without audio have no row and move nothing.
    """
    plan = dub_plan(lines, gap=gap, key=key).select(F.col(key).alias("_k"), F.col("idx").alias("_i"), "tempo", "mode", "over")
    met = lines.join(plan, (F.col(key) == F.col("_k")) & (F.col("idx") == F.col("_i")))
    heard = F.when(F.col("tempo") > 1.001, F.floor(F.col("wav_dur") / F.col("tempo") + 0.5)).otherwise(F.col("wav_dur")).cast("long")
    return place_track(met.withColumn("wav_dur", heard), gap, key).select(key, "idx", "tempo", "mode", F.col("wav_dur").alias("heard"), "place_t", "end_t")


def dense_window(lines: DataFrame, totals: DataFrame, width: int = 60_000, step: int = 5000, head: int = 90_000, tail: int = 60_000, key: str = "video_id") -> DataFrame:
    """The window of most whole lines, earliest first: outside head and tail if any line is there, else anywhere, else in the middle.

    ``totals`` has (key, total). The number of starts is rounded half to even, so the last may lie past the bound. One sweep
    over ends, windows and starts in order of time: of the lines no longer than a window, those inside are the ones that end
    by its end less the ones that start before it, so running counts of both tell them; nothing is joined by video alone.
    """
    steps = lambda lo, hi: F.when(hi >= lo, F.transform(F.sequence(F.lit(0), F.bround((hi - lo) / step).cast("int")), lambda i: lo + i * step))
    total = F.col("total")
    every = F.concat(F.transform(F.coalesce(steps(F.lit(head).cast("long"), total - tail - width), F.array().cast("array<bigint>")), lambda w: F.struct(F.lit(1).alias("tier"), w.alias("ws"))), F.transform(steps(F.lit(0).cast("long"), total - width), lambda w: F.struct(F.lit(2).alias("tier"), w.alias("ws"))))
    windows = totals.filter(total >= width).select(F.col(key).alias("_k"), F.explode(every).alias("x")).select("_k", "x.tier", "x.ws")
    # what happens at a time, in this order: lines end, windows are asked, lines start
    ask = lambda at, sign: F.struct(at.alias("at"), F.lit(1).alias("what"), F.lit(sign).alias("sign"))
    asked = windows.select("_k", "tier", "ws", F.inline(F.array(ask(F.col("ws") + width, 1), ask(F.col("ws"), -1))))
    told = lines.filter(F.col("t1") - F.col("t0") <= width).select(F.col(key).alias("_k"), F.inline(F.array(F.struct(F.col("t1").alias("at"), F.lit(0).alias("what")), F.struct(F.col("t0").alias("at"), F.lit(2).alias("what")))))
    order = Window.partitionBy("_k").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, 0)
    swept = asked.unionByName(told, allowMissingColumns=True).withColumn("ends", F.count_if(F.col("what") == 0).over(order)).withColumn("starts", F.count_if(F.col("what") == 2).over(order))
    inside = F.sum(F.when(F.col("sign") > 0, F.col("ends")).otherwise(-F.col("starts")))
    counted = swept.filter("what = 1").groupBy("_k", "tier", "ws").agg(inside.alias("n")).filter("n > 0")
    best = counted.groupBy("_k").agg(F.min(F.struct("tier", (-F.col("n")).alias("less"), "ws")).alias("b"))
    mid0, mid1 = F.greatest(F.lit(0.0), total / 2 - width / 2), F.least(total.cast("double"), total / 2 + width / 2)
    return totals.join(best, F.col(key) == F.col("_k"), "left").select(key, "total", F.coalesce(F.col("b.ws").cast("double"), mid0).alias("w0"), F.coalesce((F.col("b.ws") + width).cast("double"), mid1).alias("w1"))


def _pick_spaced(apart: int, sum_max: int, picks: int):
    """Steps of ``spaced_samples``: the state is the picks so far."""

    def step(picked: list, x: dict):
        if len(picked) < picks and all(abs(x["t0"] - a) > apart for a, _ in picked) and sum(b - a for a, b in picked) + x["t1"] - x["t0"] <= sum_max:
            picked.append((x["t0"], x["t1"]))
            yield len(picked) - 1, x["t0"], x["t1"]

    return step


def spaced_samples(segs: DataFrame, least: int = 3500, most: int = 8000, apart: int = 60_000, sum_max: int = 30_000, picks: int = 3, keys: tuple[str, ...] = ("video_id", "spk")) -> DataFrame:
    """Segments picked greedily in order: eligible length, starts more than ``apart`` from all picks, sum and number bounded. A carried scan, which holds the picks."""
    fit = segs.filter((F.col("t1") - F.col("t0")).between(least, most)).select(*keys, "t0", "t1")
    return fold(fit, list(keys), ["t0", "t1"], f"{_kinds(fit, *keys)}, place int, t0 long, t1 long", list, _pick_spaced(apart, sum_max, picks))


def speech_runs(frames: DataFrame, floor_db: float = -40.0, frame_ms: int = 100, gap_ms: int = 800, least_ms: int = 15_000, key: str = "file") -> DataFrame:
    """Runs of speech in frames (key, frame_no, db): loud frames, silent runs of at most ``gap_ms`` filled in, clipped to 15-85 % of the file.

    Rows (key, t0, t1, flat): flat is the population deviation of db over the whole run.
    """
    order = Window.partitionBy(key).orderBy("frame_no")
    loud = frames.withColumn("m", (F.col("db") > floor_db).cast("int"))
    runs = loud.withColumn("r", F.sum(F.coalesce((F.col("m") != F.lag("m").over(order)).cast("int"), F.lit(1))).over(order))
    length = F.count(F.lit(1)).over(Window.partitionBy(key, "r"))
    filled = runs.withColumn("m2", F.when((F.col("m") == 0) & (length * frame_ms > gap_ms), 0).otherwise(1))
    again = filled.withColumn("r2", F.sum(F.coalesce((F.col("m2") != F.lag("m2").over(order)).cast("int"), F.lit(1))).over(order))
    total = frames.groupBy(F.col(key).alias("_k")).agg((F.max("frame_no") + 1).alias("n"))
    found = again.filter("m2 = 1").groupBy(key, "r2").agg((F.min("frame_no") * frame_ms).alias("a"), ((F.max("frame_no") + 1) * frame_ms).alias("b"), F.stddev_pop("db").alias("flat")).filter(F.col("b") - F.col("a") >= least_ms)
    clip = found.join(total, F.col(key) == F.col("_k")).withColumn("t0", F.greatest(F.col("a").cast("double"), F.col("n") * frame_ms * 0.15)).withColumn("t1", F.least(F.col("b").cast("double"), F.col("n") * frame_ms * 0.85))
    return clip.filter(F.col("t1") - F.col("t0") >= least_ms).select(key, "t0", "t1", "flat")


def quiet_windows(frames: DataFrame, runs: DataFrame, width_ms: int = 25_000, step_ms: int = 2000, frame_ms: int = 100, dip: float = 10.0, key: str = "file") -> DataFrame:
    """Hopping windows in runs (key, t0, t1): share of frames ``dip`` under the window's median high band, and flatness of the full band.

    Frames find their run by file and time, lie in cells of a step, and a window reads the cells from its own on, so what a
    task holds is a window's frames, however long a run is.
    """
    size = max(1, step_ms // frame_ms)
    wide, near = -(-width_ms // (size * frame_ms)) + 1, 64 * size
    span = F.least(F.lit(float(width_ms)), F.col("t1") - F.col("t0"))
    starts = F.when(F.col("t1") - F.col("t0") < width_ms, F.array("t0")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0") - width_ms + 10) / step_ms).cast("int")), lambda i: F.col("t0") + i * step_ms))
    found = runs.select(F.col(key).alias("_k"), F.col("t0").alias("run"), F.floor(F.col("t0") / frame_ms).alias("f0"), F.floor(F.col("t1") / frame_ms).alias("f1"), span.alias("span"), starts.alias("starts"))
    near_runs = found.select("_k", "run", "f0", "f1", F.explode(F.sequence(F.floor(F.col("f0") / near), F.floor(F.col("f1") / near))).alias("_n"))
    met = frames.select(key, "frame_no", "db", "db_h").join(near_runs, (F.col(key) == F.col("_k")) & (F.floor(F.col("frame_no") / near) == F.col("_n")) & (F.col("frame_no") >= F.col("f0")) & (F.col("frame_no") < F.col("f1")))
    cells = met.groupBy("_k", "run", F.floor((F.col("frame_no") - F.col("f0")) / size).alias("cell")).agg(F.collect_list(F.struct("frame_no", "db", "db_h")).alias("x"))
    windows = found.select("_k", "run", "span", "f0", F.explode("starts").alias("w0")).withColumn("i0", F.floor(F.col("w0") / frame_ms)).withColumn("i1", F.floor((F.col("w0") + F.col("span")) / frame_ms)).withColumn("cell", F.floor((F.col("i0") - F.col("f0")) / size))
    on = Window.partitionBy("_k", "run").orderBy("cell").rangeBetween(0, wide)
    reads = windows.drop("f0").unionByName(cells, allowMissingColumns=True).withColumn("near", F.flatten(F.collect_list("x").over(on))).filter("w0 IS NOT NULL")
    inside = reads.withColumn("near", F.filter("near", lambda f: (f["frame_no"] >= F.col("i0")) & (f["frame_no"] < F.col("i1")))).withColumn("n", F.size("near")).filter("n >= 5")
    high = inside.withColumn("high", F.array_sort(F.col("near.db_h"))).withColumn("med", (F.get("high", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("high", F.floor(F.col("n") / 2).cast("int"))) / 2)
    mean = high.withColumn("mean", F.aggregate("near", F.lit(0.0), lambda a, f: a + f["db"]) / F.col("n"))
    flat = F.sqrt(F.aggregate("near", F.lit(0.0), lambda a, f: a + (f["db"] - F.col("mean")) * (f["db"] - F.col("mean"))) / F.col("n"))
    quiet = F.size(F.filter("high", lambda x: x < F.col("med") - dip)) / F.col("n")
    return mean.select(F.col("_k").alias(key), "w0", (F.col("w0") + F.col("span")).alias("w1"), F.round(quiet, 3).alias("quiet"), F.round(flat, 2).alias("flat"))


def _pick_quiet(want: int, guard: int):
    """Steps of ``pick_windows``: the state is the picks so far."""

    def step(picked: list, x: dict):
        if len(picked) < want and all(x["w1"] <= a - guard or x["w0"] >= b + guard for a, b in picked):
            picked.append((x["w0"], x["w1"]))
            yield x["w0"], x["w1"]

    return step


def pick_windows(windows: DataFrame, want: int = 3, least: float = 0.08, guard_ms: int = 5000, key: str = "file") -> DataFrame:
    """The quietest windows, greedily, none within ``guard_ms`` of one picked before. A carried scan, which holds the picks."""
    ok = windows.filter(F.col("quiet") >= least).select(key, (-F.col("quiet")).alias("loud"), "flat", F.col("w0").cast("double").alias("w0"), F.col("w1").cast("double").alias("w1"))
    return fold(ok, [key], ["loud", "flat", "w0", "w1"], f"{_kinds(ok, key)}, w0 double, w1 double", list, _pick_quiet(want, guard_ms))
