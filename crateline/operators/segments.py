"""Sections, regions, cues and frame tables inside tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fold_tempo, onsets_per_beat
from ..plans.ordered import Ordered, positions, runs
from ..plans.ranking import quantiles

# Labels and thresholds of sections.
INTRO, BUILDUP, DROP, BREAKDOWN, OUTRO, GROOVE = "Intro", "Build-up", "Drop/Chorus", "Breakdown", "Outro", "Groove"
HIGH_ENERGY, BASS_PRESENT, RISING, VOCAL_COVER = 0.7, 0.5, 0.35, 0.1
BEATS_PER_BAR = 4
# Regions of voice.
VOCAL_FLOOR, MERGE_GAP, MIN_REGION = 0.1, 1.0, 2.0
# Cue kinds, slots per bank, frames per second of the target's clock.
PHRASE, VOCAL_START, VOCAL_END = "phrase_start", "vocal_start", "vocal_end"
SLOTS = 8
FRAMES_PER_SECOND = 150
# Frequency bands and the least usable signal.
MIN_HZ, LOW_HZ, HIGH_HZ = 20.0, 200.0, 2000.0
MIN_SAMPLES, SILENCE = 2048, 1e-4


# --- intervals -----------------------------------------------------------------------------

def _bins(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width)))


def overlaps(left: DataFrame, right: DataFrame, by: str, width: float, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping intervals of equal ``by``: an equi-join on time bins, each pair reported once.

    ``right``'s interval comes back as r_start and r_end. Bins cut a long track into many keys.
    """
    a = left.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width)))
    b = right.select(F.col(by), F.col(start).alias("r_start"), F.col(end).alias("r_end")).withColumn(
        "_bin", F.explode(_bins(F.col("r_start"), F.col("r_end"), width)))
    once = F.col("_bin") == F.floor(F.greatest(F.col(start), F.col("r_start")) / width)
    touch = (F.col("r_end") > F.col(start)) & (F.col("r_start") < F.col(end))
    return a.join(b, [by, "_bin"]).filter(touch & once).drop("_bin")


def points_in(intervals: DataFrame, points: DataFrame, by: str, width: float, t: str = "t", closed: bool = False) -> DataFrame:
    """Points with start <= t < end (or <= end), by the same bins."""
    a = intervals.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    b = points.withColumn("_bin", F.floor(F.col(t) / width))
    upper = F.col(t) <= F.col("end") if closed else F.col(t) < F.col("end")
    return a.join(b, [by, "_bin"]).filter((F.col(t) >= F.col("start")) & upper).drop("_bin")


def vocal_cover(sections: DataFrame, regions: DataFrame, by: str = "track", order: str = "ord", width: float = 30.0) -> DataFrame:
    """Share of every section covered by regions, and whether that makes it vocal."""
    shared = F.greatest(F.lit(0.0), F.least("r_end", "end") - F.greatest("r_start", "start"))
    covered = overlaps(sections.select(by, order, "start", "end"), regions, by, width).groupBy(by, order).agg(F.sum(shared).alias("_covered"))
    length = F.col("end") - F.col("start")
    score = F.when(length > 0, F.coalesce("_covered", F.lit(0.0)) / length).otherwise(0.0)
    return sections.join(covered, [by, order], "left").withColumn("vocal_score", score).withColumn(
        "vocal", F.col("vocal_score") >= VOCAL_COVER).drop("_covered")


def active_regions(frames: Ordered, floor: float = VOCAL_FLOOR, merge_gap: float = MERGE_GAP, min_region: float = MIN_REGION,
                   t: str = "t", ratio: str = "ratio") -> DataFrame:
    """Runs of frames at or above the floor. A run ends at its first inactive frame; runs closer
    than the gap become one; short ones go."""
    by = list(frames.by)
    active = frames.with_rows(frames.rows.withColumn("_on", F.coalesce(F.col(ratio) >= floor, F.lit(False))))
    active = active.shifted({"_next": (t, -1)})
    numbered = runs(active, "_on")
    spans = numbered.rows.filter("_on").groupBy(*by, "run").agg(
        F.min(t).alias("start"), F.max_by(F.coalesce("_next", t), frames.pos).alias("end")).drop("run")
    ordered = positions(spans, by, ["start"], "_at").shifted({"_prev_end": ("end", 1)})
    far = F.when(F.col("start") - F.col("_prev_end") <= merge_gap, 0).otherwise(1)
    merged = ordered.running_sum(far, "_region").rows.groupBy(*by, "_region").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).drop("_region")
    return merged.filter(F.col("end") - F.col("start") >= min_region)


# --- sections ------------------------------------------------------------------------------

def phrase_ends(phrases: Ordered, start: str = "start", end: str = "end") -> DataFrame:
    """Every phrase ends where the next one starts; the last keeps its own end."""
    return phrases.shifted({"_next": (start, -1)}).rows.withColumn("phrase_end", F.coalesce("_next", F.col(end))).drop("_next")


def cut_sections(boundaries: DataFrame, tracks: DataFrame, by: str = "track") -> Ordered:
    """Sections between the distinct clamped boundaries of (track, time); tracks carry duration and bpm."""
    known = tracks.filter(F.col("duration") > 0)
    times = boundaries.select(by, "time").unionByName(known.select(by, F.lit(0.0).alias("time")))
    starts = times.join(known, by).withColumn(
        "start", F.greatest(F.lit(0.0), F.least("time", "duration"))).select(by, "start", "duration", "bpm").distinct()
    seq = positions(starts, [by], ["start"], "ord").shifted({"_next": ("start", -1)})
    rows = seq.rows.withColumn("end", F.coalesce("_next", "duration"))
    bar = F.lit(BEATS_PER_BAR * 60.0) / F.nullif("bpm", F.lit(0.0))
    return seq.with_rows(rows.withColumn("bars", (F.col("end") - F.col("start")) / bar).drop("_next"))


def section_features(sections: DataFrame, frames: DataFrame, by: str = "track", order: str = "ord", width: float = 10.0) -> DataFrame:
    """Energy and bass of every section relative to the track's largest, and how its energy rises.

    ``frames`` is (track, t, total, low). A section without a frame takes the next frame, else the last one.
    """
    keys = [by, order]
    inside = points_in(sections.select(*keys, "start", "end"), frames, by, width).select(*keys, "t", "total", "low")
    empty = sections.join(inside.select(*keys).distinct(), keys, "left_anti").select(*keys, "start")
    if not empty.isEmpty():
        ahead = empty.join(frames, by).groupBy(*keys).agg(F.min_by(F.struct("t", "total", "low"), F.struct(
            F.col("t") < F.col("start"), F.when(F.col("t") >= F.col("start"), F.col("t")).otherwise(-F.col("t")))).alias("f"))
        inside = inside.unionByName(ahead.select(*keys, "f.*"))
    numbered = positions(inside, keys, ["t"], "_i").rows
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n"))
    third = F.floor(F.col("_n") / 3)
    told = numbered.join(sizes, keys).groupBy(*keys).agg(
        F.avg("total").alias("_energy"), F.avg("low").alias("_bass"),
        F.avg(F.when(F.col("_i") < third, F.col("total"))).alias("_head"),
        F.avg(F.when(F.col("_i") >= F.col("_n") - third, F.col("total"))).alias("_tail"))
    peaks = told.groupBy(by).agg(F.max("_energy").alias("_e"), F.max("_bass").alias("_b"))
    top = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    slope = F.when(F.col("_energy") > 0, F.coalesce((F.col("_tail") - F.col("_head")) / F.col("_energy"), F.lit(0.0))).otherwise(0.0)
    return told.join(peaks, by).select(*keys, (F.col("_energy") / top("_e")).alias("energy"),
                                       (F.col("_bass") / top("_b")).alias("bass"), slope.alias("slope"))


def label_sections(sections: Ordered) -> Ordered:
    """Drop, then breakdown, then build-up, then the edges; one section is a groove, two are ends."""
    drop = (F.col("energy") >= HIGH_ENERGY) & (F.col("bass") >= BASS_PRESENT) & (F.col("slope") < RISING)
    seq = sections.with_rows(sections.rows.withColumn("_drop", drop)).shifted({
        "_prev_energy": ("energy", 1), "_next_energy": ("energy", -1), "_next_drop": ("_drop", -1)})
    sizes = sections.rows.groupBy(*sections.by).agg(F.count("*").alias("_n"))
    rows = seq.rows.join(sizes, list(sections.by))
    first, last = F.col(sections.pos) == 0, F.col(sections.pos) == F.col("_n") - 1
    breakdown = (~F.col("_drop") & ~first & ~last & (F.col("slope") < RISING) & (F.col("bass") < BASS_PRESENT)
                 & (F.col("energy") < HIGH_ENERGY) & (F.col("energy") < F.col("_prev_energy")))
    rising = (F.col("slope") >= RISING) & (F.col("_next_energy") >= F.col("energy"))
    before_drop = F.col("_next_drop") & (F.col("energy") < F.col("_next_energy"))
    middle = (F.when(F.col("_drop"), DROP).when(breakdown, BREAKDOWN)
              .when(~last & (rising | before_drop), BUILDUP).otherwise(GROOVE))
    label = (F.when(F.col("_n") == 1, GROOVE).when(F.col("_n") == 2, F.when(first, INTRO).otherwise(OUTRO))
             .when(first & ~F.col("_drop"), INTRO).when(last & ~F.col("_drop"), OUTRO).otherwise(middle))
    return sections.with_rows(rows.withColumn("label", label).drop("_drop", "_prev_energy", "_next_energy", "_next_drop", "_n"))


def merge_sections(sections: Ordered, label: str = "label") -> DataFrame:
    """Consecutive sections of one label: last end, highest energy."""
    return runs(sections, label).rows.groupBy(*sections.by, "run", label).agg(
        F.min("start").alias("start"), F.max_by("end", sections.pos).alias("end"), F.max("energy").alias("energy"))


# --- cues ----------------------------------------------------------------------------------

def cue_rows(tracks: DataFrame, by: str = "track") -> DataFrame:
    """One row per phrase, two per region, from the nested ``sections`` and ``regions`` of a track."""
    beat = 60.0 / F.nullif("bpm", F.lit(0.0))
    length = F.col("s.end") - F.col("s.start")
    phrases = tracks.select(by, "bpm", F.posexplode("sections").alias("n", "s")).select(
        by, F.concat(F.lit("sec"), "n").alias("id"), F.lit(PHRASE).alias("kind"), F.col("s.label").alias("label"),
        F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.bround(length / beat, 1).alias("beats"))
    none = F.lit(None).cast("double")
    halves = tracks.select(by, F.posexplode("regions").alias("n", "r")).select(by, "n", F.inline(F.array(
        F.struct(F.lit("vs").alias("p"), F.lit(VOCAL_START).alias("kind"), F.lit("Vocal start").alias("label"), F.col("r.start").alias("start")),
        F.struct(F.lit("ve").alias("p"), F.lit(VOCAL_END).alias("kind"), F.lit("Vocal end").alias("label"), F.col("r.end").alias("start")))))
    return phrases.unionByName(halves.select(by, F.concat("p", "n").alias("id"), "kind", "label", "start", none.alias("end"), none.alias("beats")))


def pair_halves(cues: DataFrame, by: str = "track") -> DataFrame:
    """Start halves with their end; ``paired`` is false for a missing or an early end and for ends alone."""
    number = F.substring("id", 3, 1 << 30)
    starts = cues.filter(F.col("kind") == VOCAL_START).select(by, number.alias("_no"), F.col("id").alias("start_id"), F.col("start").alias("_from"))
    ends = cues.filter(F.col("kind") == VOCAL_END).select(by, number.alias("_no"), F.col("id").alias("end_id"), F.col("start").alias("_to"))
    both = starts.join(ends, [by, "_no"], "full")
    paired = F.coalesce(F.col("_to") > F.col("_from"), F.lit(False))
    return both.select(by, "start_id", "end_id", F.col("_from").alias("start"), F.col("_to").alias("end"), paired.alias("paired"))


def unpaired(cues: DataFrame, by: str = "track") -> DataFrame:
    """Ids of halves without a partner: starts with no later end, ends with no start at all."""
    lone = pair_halves(cues, by).filter(~F.col("paired"))
    return lone.select(by, F.coalesce("start_id", "end_id").alias("id"))


def two_bank_plan(cues: DataFrame, by: str = "track") -> DataFrame:
    """First eight phrases take pads, first eight regions take loops; the rest is dropped or unpaired."""
    phrases = positions(cues.filter(F.col("kind") == PHRASE).select(by, "id", "start"), [by], ["start", "id"], "_at").rows
    pads = phrases.select(by, "id", F.when(F.col("_at") < SLOTS, F.concat(F.lit("Cue "), F.col("_at") + 1)).alias("slot"))
    halves = pair_halves(cues, by)
    regions = positions(halves.filter("paired"), [by], ["start", "start_id"], "_at").rows
    named = F.when(F.col("_at") < SLOTS, F.concat(F.lit("Loop "), F.col("_at") + 1))
    loops = regions.select(by, named.alias("slot"), F.explode(F.array("start_id", "end_id")).alias("id"))
    alone = unpaired(cues, by).withColumn("_alone", F.lit(True))
    plan = cues.join(pads.unionByName(loops), [by, "id"], "left").join(alone, [by, "id"], "left")
    state = F.when(F.col("slot").isNotNull(), "placed").when(F.col("_alone"), "unpaired").otherwise("dropped")
    return plan.withColumn("state", state).withColumn("slot", F.coalesce("slot", F.lit(""))).drop("_alone")


def one_bank_plan(cues: DataFrame, by: str = "track") -> DataFrame:
    """Markers in time order: those that ask take pads 1..8, all others are memory markers."""
    ends = pair_halves(cues, by).filter("paired").select(by, F.col("start_id").alias("id"), F.col("end").alias("_stop"))
    rows = cues.filter(F.col("kind") == PHRASE).withColumn("_stop", F.lit(None).cast("double")).unionByName(
        cues.filter(F.col("kind") == VOCAL_START).join(ends, [by, "id"]), allowMissingColumns=True)
    asking = F.coalesce("hot", F.lit(False))
    asked = positions(rows.filter(asking).select(by, "id", "start"), [by], ["start", "id"], "_at").rows
    pads = asked.filter(F.col("_at") < SLOTS).select(by, "id", (F.col("_at") + 1).cast("int").alias("pad"))
    what = F.when(F.col("_stop").isNotNull(), "loop").otherwise("cue")
    letter = F.substring(F.lit("ABCDEFGH"), F.col("pad"), F.lit(1))
    told = F.when(F.col("pad").isNotNull(), F.concat(F.lit("Hot "), what, F.lit(" "), letter)).otherwise(F.concat(F.lit("Memory "), what))
    return rows.join(pads, [by, "id"], "left").select(by, "id", "label", "start", F.col("_stop").alias("end"), "pad", told.alias("slot"))


def fit_to_free(markers: DataFrame, taken: DataFrame, by: str = "track") -> DataFrame:
    """The k-th asking marker takes the k-th free pad of (track, pad) taken ones; the others become memory markers."""
    asking = positions(markers.filter(F.col("pad").isNotNull()).select(by, "id", "start"), [by], ["start", "id"], "_at").rows
    used = taken.filter(F.col("pad").between(1, SLOTS)).groupBy(by).agg(F.collect_set("pad").alias("_used"))
    free = F.array_except(F.sequence(F.lit(1), F.lit(SLOTS)), F.coalesce("_used", F.expr("cast(array() as array<int>)")))
    fitted = asking.join(used, by, "left").filter(F.col("_at") < SLOTS).select(
        by, "id", F.try_element_at(free, (F.col("_at") + 1).cast("int")).alias("pad"))
    return markers.drop("pad").join(fitted, [by, "id"], "left")


def check_markers(markers: DataFrame, by: str = "track") -> DataFrame:
    """Broken rules per track: pads out of range, two markers on a pad, early starts, loops that end before they begin."""
    known = F.col("pad").isNotNull()
    return markers.groupBy(by).agg(
        F.count("*").alias("markers"), F.count_if(known & ~F.col("pad").between(1, SLOTS)).alias("out_of_range"),
        (F.count_if(known & F.col("pad").between(1, SLOTS))
         - F.count_distinct(F.when(F.col("pad").between(1, SLOTS), F.col("pad")))).alias("repeated"),
        F.count_if(F.col("start") < 0).alias("early"), F.count_if(F.col("end") <= F.col("start")).alias("backward"))


def cue_values(start: str = "start", end: str = "end", pad: str = "pad", label: str = "label") -> dict[str, Column]:
    """A marker as stored numbers: milliseconds, frames, slot kind, label cut at 255 characters."""
    at = F.greatest(F.lit(0), F.bround(F.col(start) * 1000, 0).cast("long"))
    out = F.greatest(at, F.bround(F.col(end) * 1000, 0).cast("long"))
    frame = lambda ms: F.floor(ms * FRAMES_PER_SECOND / 1000)
    open_end = F.col(end).isNull()
    return {"in_ms": at, "in_frame": frame(at), "kind": F.coalesce(F.nullif(F.col(pad), F.lit(0)), F.lit(0)),
            "out_ms": F.when(open_end, -1).otherwise(out), "out_frame": F.when(open_end, 0).otherwise(frame(out)),
            "comment": F.substring(F.coalesce(label, F.lit("")), 1, 255)}


# --- frames and spectra --------------------------------------------------------------------

def usable(samples: DataFrame, by: str = "track", value: str = "x") -> DataFrame:
    """Enough samples and more than silence."""
    power = F.sqrt(F.avg(F.col(value).cast("double") * F.col(value)))
    return samples.groupBy(by).agg(((F.count("*") >= MIN_SAMPLES) & (power > SILENCE)).alias("usable"))


def ending_ratio(frames: Ordered, tail: int, value: str = "rms") -> DataFrame:
    """Mean of the last ``tail`` frames over the median of all; NULL when the median is not above zero."""
    by = list(frames.by)
    sizes = frames.rows.groupBy(*by).agg(F.count("*").alias("_n"))
    last = frames.rows.join(sizes, by).filter(F.col(frames.pos) >= F.col("_n") - tail).groupBy(*by).agg(F.avg(value).alias("_tail"))
    middle = quantiles(frames.rows, value, (0.5,), by).select(*by, F.col("q")[0].alias("_median"))
    return last.join(middle, by).select(*by, F.when(F.col("_median") > 0, F.col("_tail") / F.col("_median")).alias("ending"))


def groove(onsets: Ordered, t: str = "t") -> DataFrame:
    """1 - min(1, spread of gaps / mean gap); NULL under eight onsets or four positive gaps."""
    gaps = onsets.shifted({"_prev": (t, 1)}).rows.withColumn("_gap", F.col(t) - F.col("_prev"))
    gap = F.when(F.col("_gap") > 0, F.col("_gap"))
    told = gaps.groupBy(*onsets.by).agg(F.count("*").alias("n"), F.count(gap).alias("gaps"), F.stddev_pop(gap).alias("s"), F.avg(gap).alias("m"))
    value = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.col("s") / F.col("m")))
    return told.select(*onsets.by, F.when((F.col("n") >= 8) & (F.col("gaps") >= 4) & (F.col("m") > 0), value).alias("groove"))


def bass_share(spectrum: DataFrame, by: str = "track") -> DataFrame:
    total = F.sum(F.when(F.col("freq") >= MIN_HZ, F.col("power")))
    low = F.sum(F.when((F.col("freq") >= MIN_HZ) & (F.col("freq") < LOW_HZ), F.col("power")).otherwise(0.0))
    return spectrum.groupBy(by).agg(F.when(total > 0, low / total).alias("bass"))


def brightness(spectrum: DataFrame, by: str = "track") -> DataFrame:
    loud = F.when(F.col("freq") >= MIN_HZ, F.sqrt("power"))
    return spectrum.groupBy(by).agg(F.when(F.sum(loud) > 0, F.sum(F.col("freq") * loud) / F.sum(loud)).alias("bright"))


def pulse(envelope: Ordered, tempos: DataFrame, per_second: float, value: str = "env") -> DataFrame:
    """Depth of the envelope's movement at the beat, against its tapered level."""
    by = list(envelope.by)
    sizes = envelope.rows.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = envelope.rows.join(sizes, by).join(tempos.select(*by, fold_tempo("bpm").alias("_bpm")), by)
    i = F.col(envelope.pos)
    taper = F.when(F.col("_n") == 1, 1.0).otherwise(0.5 - 0.5 * F.cos(2 * F.pi() * i / (F.col("_n") - 1)))
    turn = 2 * F.pi() * (F.col("_bpm") / 60.0) / per_second * i
    env = F.col(value)
    told = rows.groupBy(*by).agg(
        F.max("_n").alias("n"), F.max("_bpm").alias("bpm"), F.sum(taper).alias("t"), F.sum(env * taper).alias("level"),
        F.sum(env * taper * F.cos(turn)).alias("c"), F.sum(env * taper * F.sin(turn)).alias("s"))
    long_enough = F.col("n") / per_second * F.col("bpm") / 60.0 >= 4
    depth = 2 * F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("level")
    return told.select(*by, F.when(long_enough & (F.col("level") > 0), depth).alias("pulse"))


def ingredients(tracks: DataFrame, samples: DataFrame, spectrum: DataFrame, envelope: Ordered, per_second: float) -> DataFrame:
    """The four raw measures of every track (track, bpm, onset_rate); an unusable signal has none."""
    by = "track"
    joined = (tracks.join(usable(samples), by, "left").join(bass_share(spectrum), by, "left").join(brightness(spectrum), by, "left")
              .join(pulse(envelope, tracks, per_second), by, "left"))
    good = F.coalesce("usable", F.lit(False))
    values = {"energy_density": onsets_per_beat("onset_rate", "bpm"), "energy_bass": F.col("bass"),
              "energy_bright": F.col("bright"), "energy_pulse": F.col("pulse")}
    return joined.select(by, *[F.when(good, v).alias(k) for k, v in values.items()])


def _split_bin(i: Column, n: Column, bins: int) -> Column:
    """Bin of item i when n items go into even bins, the first ones one longer."""
    parts = F.least(F.lit(bins), n)
    size, longer = F.floor(n / parts), n % parts
    edge = longer * (size + 1)
    return F.when(i < edge, F.floor(i / (size + 1))).otherwise(longer + F.floor((i - edge) / size))


def wave_bands(frames: Ordered, bins: int) -> DataFrame:
    """At most ``bins`` bins per track: mean level over the loudest, bands over their 99th percentile."""
    by = list(frames.by)
    sizes = frames.rows.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = frames.rows.join(sizes, by).withColumn("bin", _split_bin(F.col(frames.pos), F.col("_n"), bins).cast("long"))
    names = ("low", "mid", "high")
    means = rows.groupBy(*by, "bin").agg(F.avg("t").alias("t"), F.avg("total").alias("total"), *[F.avg(c).alias(c) for c in names])
    tops = means.groupBy(*by).agg(F.max("total").alias("_total"), *[F.max(c).alias(f"_{c}_max") for c in names])
    out = means.join(tops, by)
    for c in names:
        out = out.join(quantiles(means, c, (0.99,), by).select(*by, F.col("q")[0].alias(f"_{c}")), by)
    ref = lambda c: F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).when(F.col(f"_{c}_max") > 0, F.col(f"_{c}_max")).otherwise(1.0)
    return out.select(*by, "bin", "t", (F.col("total") / F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)).alias("level"),
                      *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / ref(c))).alias(c) for c in names])


def peak_envelope(samples: Ordered, points: int = 800, value: str = "x") -> DataFrame:
    """Largest magnitude of ``points`` equal bins, over the loudest; nothing for shorter tracks."""
    by = list(samples.by)
    sizes = samples.rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= points)
    per_bin = F.floor(F.col("_n") / points)
    rows = samples.rows.join(sizes, by).withColumn("bin", F.floor(F.col(samples.pos) / per_bin)).filter(F.col("bin") < points)
    peaks = rows.groupBy(*by, "bin").agg(F.max(F.abs(value)).alias("_peak"))
    loudest = peaks.groupBy(*by).agg(F.max("_peak").alias("_top"))
    top = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return peaks.join(loudest, by).select(*by, "bin", F.bround(F.col("_peak") / top, 3).alias("peak"))


def pooled(vectors: DataFrame, by: str = "track", vec: str = "vec") -> DataFrame:
    """Mean vector of a track's frames, summed on the map side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    dense = vectors.select(by, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return dense.groupBy(by).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(by, vector_to_array("_m").alias(vec))


def fingerprint(df: DataFrame, group: int = 10, vec: str = "vec") -> DataFrame:
    """Vectors as rows of (id, column, value): dimensions averaged by tens, centred on the column's
    median and scaled by the 90th percentile of its deviations, inside -1..1."""
    columns = F.floor(F.size(vec) / group).cast("int")
    cells = df.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), columns - 1), lambda c: F.aggregate(
        F.slice(vec, c * group + 1, F.lit(group)), F.lit(0.0), lambda s, x: s + x.cast("double")) / group)).alias("column", "value"))
    middle = quantiles(cells, "value", (0.5,), ["column"]).select("column", F.col("q")[0].alias("_centre"))
    centred = cells.join(middle, "column").withColumn("_off", F.col("value") - F.col("_centre"))
    wide = quantiles(centred, F.abs("_off"), (0.9,), ["column"]).select("column", F.col("q")[0].alias("_spread"))
    scaled = F.col("_off") / F.greatest(F.col("_spread"), F.lit(1e-9))
    return centred.join(wide, "column").select("id", "column", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled)).alias("value"))


def window_starts(duration: Column, window: float = 10.0, count: int = 12) -> Column:
    """Starts of the analysis windows: evenly spread, clamped to the end, close ones left out."""
    shares = [(i + 0.5) / count for i in range(count)]
    at = lambda share: F.least(F.greatest(F.lit(0.0), duration * share - window / 2), duration - window)
    spread = F.array(*[at(s) for s in shares])
    kept = F.aggregate(spread, F.expr("cast(array() as array<double>)"), lambda out, s: F.when(
        F.exists(out, lambda o: F.abs(s - o) <= window / 4), out).otherwise(F.concat(out, F.array(s))))
    return F.when(duration <= window, F.array(F.lit(0.0))).otherwise(kept)


def rhythm_start(duration: Column, seconds: float = 30.0) -> Column:
    return F.greatest(F.lit(0.0), (duration - seconds) / 2)
