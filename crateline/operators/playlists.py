"""Playlists as long tables: playlist, dense 0-based position, track."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions import keys
from ..functions.columns import col
from ..functions.text import absolute_path, base_name, composed, stem
from ..plans.ordered import Ordered, positions, runs
from .cost import pair_cost
from .moves import followed

ORDER_FIELDS = {"bpm": "bpm", "energy": "energy", "key": "camelot"}


def order_by(df: DataFrame, field: str, tie: Seq[str], descending: bool = False) -> DataFrame:
    """Order by tempo, energy or key wheel; unknown last both ways; earlier order breaks ties."""
    value = keys.wheel_rank("camelot") if field == "key" else F.col(ORDER_FIELDS.get(field, field)).cast("double")
    value = F.when(~F.isnan(value.cast("double")), value)
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), *tie)


def to_catalogue(entries: DataFrame, catalogue: DataFrame, on: str = "path") -> DataFrame:
    """Look every entry up; entries the catalogue does not know stay, without measures."""
    return entries.join(catalogue.withColumn("known", F.lit(True)), on, "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def playlist_positions(entries: DataFrame, catalogue: DataFrame, playlist: str = "playlist", pos: str = "pos",
                       id_column: str = "id") -> DataFrame:
    """Match by composed path, else by composed file name (the first catalogue row wins);
    ``first_pos`` is where a track enters, ``found`` is false for entries nobody knows."""
    keyed = catalogue.select(id_column, composed("path").alias("_p")).withColumn("_f", base_name("_p"))
    by_path = keyed.groupBy("_p").agg(F.min(id_column).alias("_by_path"))
    by_name = keyed.groupBy("_f").agg(F.min(id_column).alias("_by_name"))
    # A path is resolved once, however many entries have it; entries are joined and grouped in one go, found or not.
    asked = entries.select("path").distinct().withColumn("_p", composed(absolute_path("path"))).withColumn("_f", base_name("_p"))
    known = asked.join(by_path, "_p", "left").join(by_name, "_f", "left").select("path", F.coalesce("_by_path", "_by_name").alias(id_column))
    hit = entries.join(known, "path", "left")
    lost = F.col(id_column).isNull()
    grouped = hit.groupBy(playlist, id_column, F.when(lost, F.col(pos)).alias("_pos"), F.when(lost, F.col("path")).alias("_path")).agg(
        F.min(pos).alias("first_pos"), F.min_by("path", pos).alias("_first"), F.count("*").alias("_n"))
    times = F.when(lost, F.col("_n")).otherwise(1).cast("int")
    return grouped.withColumn("_one", F.explode(F.array_repeat(F.lit(True), times))).select(
        playlist, id_column, "first_pos", F.when(lost, F.col("_path")).otherwise(F.col("_first")).alias("path"), (~lost).alias("found"))


def signed_deltas(previous: dict[str, Column], current: dict[str, Column]) -> dict[str, Column]:
    """Tempo, key, groove and energy against the entry before; absent on either side is absent."""
    return {
        "d_bpm": F.bround(keys.tempo_shift(previous["bpm"], current["bpm"]), 0).cast("int"),
        "d_key": keys.steps_between(previous["wheel"], current["wheel"]).cast("int"),
        "d_mode": previous["mode"] != current["mode"],
        "d_groove": F.bround(current["danceability"] - previous["danceability"], 2),
        "d_energy": (fmt.decile(current["energy"]) - fmt.decile(previous["energy"])).cast("int"),
    }


MEASURES = ("bpm", "wheel", "mode", "danceability", "energy")


def measures_of(prefix: str = "") -> dict[str, Column]:
    """What deltas are taken of; a key is parsed once into its place and mode."""
    code = f"{prefix}camelot"
    return {**{c: F.col(prefix + c) for c in ("bpm", "danceability", "energy")},
            "wheel": keys.wheel_number(code), "mode": keys.wheel_mode(code)}


def with_deltas(seq: Ordered) -> Ordered:
    """Deltas of every entry to the one right before it, whether or not that one is known."""
    own = {f"_own_{c}": value for c, value in measures_of().items()}
    shifted = seq.with_rows(seq.rows.withColumns(own)).shifted({f"_prev_{c}": (f"_own_{c}", 1) for c in MEASURES})
    deltas = signed_deltas({c: F.col(f"_prev_{c}") for c in MEASURES}, {c: F.col(f"_own_{c}") for c in MEASURES})
    return shifted.with_rows(shifted.rows.withColumns(deltas).drop(*own, *[f"_prev_{c}" for c in MEASURES]))


def delta_texts() -> dict[str, Column]:
    """``+2``, ``rel`` (same place, other mode), ``=``, ``+.05``; with -1, 0 or 1 for the way."""
    key = (F.when(F.col("d_key") != 0, fmt.signed("d_key")).when(F.col("d_mode"), F.lit("rel"))
           .when(F.col("d_key") == 0, F.lit("=")))
    groove = F.when(F.col("d_groove").isNotNull(),
                    F.regexp_replace(F.format_string("%+.2f", F.col("d_groove")), "0\\.", "."))
    return {
        "t_bpm": F.when(F.col("d_bpm").isNotNull(), fmt.signed("d_bpm")),
        "t_key": key,
        "t_groove": groove,
        "t_energy": F.when(F.col("d_energy").isNotNull(), fmt.signed("d_energy")),
        "way_bpm": fmt.direction("d_bpm"), "way_key": fmt.direction("d_key"),
        "way_groove": fmt.direction("d_groove"), "way_energy": fmt.direction("d_energy"),
    }


def chain_table(seq: Ordered, known: str = "known") -> DataFrame:
    """Numbered known entries with deltas; unknown ones are left out but still break the chain."""
    return with_deltas(seq).rows.filter(F.col(known)).withColumn("number", F.col(seq.pos) + 1)


def playlist_table(seq: Ordered, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Every entry with the cost of coming from the one before, three decimals."""
    shifted = seq.shifted({"_vec": ("vec", 1), "_bpm": ("bpm", 1), "_key": ("camelot", 1)})
    cost = pair_cost("_vec", "vec", "_bpm", "bpm", "_key", "camelot", weights)
    step = F.when((F.col(seq.pos) > 0) & F.col("_vec").isNotNull() & F.col("vec").isNotNull(), F.bround(cost, 3))
    return shifted.rows.withColumn("number", F.col(seq.pos) + 1).withColumn("from_previous", step).drop(
        "_vec", "_bpm", "_key")


def regions(seq: Ordered, label: str) -> DataFrame:
    """Runs of equal labels as (start, end); an unknown label breaks a run and has none."""
    numbered = runs(seq, label).rows
    return (numbered.filter(F.col(label).isNotNull()).groupBy(*seq.by, "run", label)
            .agg(F.min(seq.pos).alias("start"), F.max(seq.pos).alias("end")).drop("run"))


def doubles(entries: DataFrame, key: str, playlist: str = "playlist", pos: str = "pos") -> DataFrame:
    """Entries whose song was already played: the first one stays, later ones point to it."""
    firsts = entries.groupBy(playlist, key).agg(F.min(pos).alias("copy_of"))
    return entries.join(firsts, [playlist, key]).filter(F.col(pos) > F.col("copy_of"))


def moved(entries: DataFrame, source: Column | int, target: Column | int, size: Column, pos: str = "pos") -> DataFrame:
    """One entry to another place (1-based target), the ones between slide by one."""
    source = F.lit(source) if isinstance(source, int) else source
    target = F.lit(target) if isinstance(target, int) else target
    goal = F.greatest(F.lit(1), F.least(size, target)) - 1
    here = F.col(pos)
    place = (F.when((source < 0) | (source >= size), here).when(here == source, goal)
             .when((source < here) & (here <= goal), here - 1)
             .when((goal <= here) & (here < source), here + 1).otherwise(here))
    return entries.withColumn("new_pos", place.cast("long"))


def moved_all(entries: DataFrame, moves: DataFrame, playlist: str = "playlist", pos: str = "pos") -> DataFrame:
    """Several moves per playlist, applied in row order: (playlist, row, place).

    ``row`` names the entry by its original position; rows that are not there are passed over,
    places beyond an end mean that end. Any number of moves in lists of any length.
    """
    sizes = entries.groupBy(playlist).agg(F.count("*").alias("size"))
    asked = moves.select(playlist, F.col("row").cast("long").alias("row"), F.col("place").cast("long").alias("place"))
    asked = asked.join(sizes, playlist).filter((F.col("row") >= 0) & (F.col("row") < F.col("size")) & F.col("place").isNotNull())
    return followed(entries, asked, playlist, pos)


def appended(current: DataFrame, incoming: DataFrame, playlist: str = "playlist", track: str = "track",
             pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The queue after adding, without repeats, and the tracks skipped, once each in order of arrival."""
    both = current.withColumn("_source", F.lit(0)).unionByName(incoming.withColumn("_source", F.lit(1)))
    place = F.struct("_source", pos)
    seen = both.groupBy(playlist, track).agg(
        F.min(place).alias("_first"), F.count_if(F.col("_source") == 1).alias("_came"),
        F.min(F.when(F.col("_source") == 1, F.col(pos))).alias("_arrived"), F.count("*").alias("_times"))
    merged = positions(seen.select(playlist, track, "_first"), [playlist], ["_first", track], "new_pos").rows
    repeated = seen.filter((F.col("_came") > 0) & ((F.col("_first._source") == 0) | (F.col("_came") > 1)))
    return merged.drop("_first"), repeated.select(playlist, track, F.col("_arrived").alias("arrived"))


def shared_tracks(entries: DataFrame, playlist: str = "playlist", track: str = "track") -> DataFrame:
    """Tracks with several homes, one row per home."""
    homes = entries.select(playlist, track).distinct()
    several = homes.groupBy(track).agg(F.count("*").alias("homes")).filter(F.col("homes") > 1)
    return homes.join(several, track)


def _ends(low: Column, high: Column) -> Column:
    a, b = F.bround(low, 0).cast("long"), F.bround(high, 0).cast("long")
    return (F.when(low.isNull(), F.lit("—")).when(a == b, a.cast("string"))
            .otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string"))))


def shelf_rows(entries: DataFrame, catalogue: DataFrame, playlist: str = "playlist", track: str = "track") -> DataFrame:
    """One line per playlist. Keys are a set of at most 24 codes."""
    several = shared_tracks(entries, playlist, track).select(track).distinct().withColumn("_shared", F.lit(1))
    rows = entries.join(catalogue, track, "left").join(several, track, "left")
    number = keys.wheel_rank("camelot")
    code = F.when(number.isNotNull(), F.struct(number.alias("rank"), F.col("camelot").alias("code")))
    told = rows.groupBy(playlist).agg(
        F.count("*").alias("tracks"), F.min("bpm").alias("_low"), F.max("bpm").alias("_high"),
        F.avg("energy").alias("_energy"), F.array_sort(F.collect_set(code)).alias("_keys"),
        F.sum(F.coalesce("duration", F.lit(0.0))).alias("_seconds"), F.count("_shared").alias("shared"))
    joined = F.array_join(F.transform("_keys", lambda k: k["code"]), " ")
    return told.select(
        playlist, "tracks", _ends(F.col("_low"), F.col("_high")).alias("bpm"), fmt.energy_bar("_energy").alias("energy"),
        F.when(joined == "", F.lit("—")).otherwise(joined).alias("keys"), fmt.length_told("_seconds").alias("length"),
        "shared")


def shelf_shared_text(entries: DataFrame, playlist: str = "playlist", track: str = "track") -> DataFrame:
    """For every shared track of a playlist, how many other homes it has and the first of them."""
    several = shared_tracks(entries, playlist, track)
    ends = several.groupBy(track).agg(F.min(playlist).alias("_first"), F.max(playlist).alias("_last"),
                                      F.max("homes").alias("homes"))
    other = F.when(F.col("_first") != F.col(playlist), F.col("_first")).otherwise(F.col("_last"))
    return several.drop("homes").join(ends, track).select(
        playlist, track, (F.col("homes") - 1).alias("others"), other.alias("also_in"))


def shelf_summary(entries: DataFrame, catalogue: DataFrame, playlist: str = "playlist", track: str = "track") -> DataFrame:
    whole = entries.join(catalogue.select(track, "duration"), track, "left").groupBy(playlist).agg(
        F.count("*").alias("_tracks"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("_seconds"))
    totals = whole.agg(F.count("*").alias("playlists"), F.sum("_tracks").alias("tracks"), F.sum("_seconds").alias("seconds"))
    several = shared_tracks(entries, playlist, track).agg(F.count_distinct(track)).scalar()
    return totals.select("playlists", "tracks", fmt.length_told("seconds").alias("length"), several.alias("shared"))


def external_plan(entries: DataFrame, library: DataFrame, existing: DataFrame, playlist: str = "playlist",
                  track: str = "track") -> DataFrame:
    """Per playlist: tracks the other library knows, tracks it does not, and whether it replaces one."""
    known = library.select(track).distinct().withColumn("_known", F.lit(True))
    there = existing.select(playlist).distinct().withColumn("replaces", F.lit(True))
    counted = entries.join(known, track, "left").groupBy(playlist).agg(
        F.count("_known").alias("found"), (F.count("*") - F.count("_known")).alias("missing"))
    return counted.join(there, playlist, "left").withColumn("replaces", F.coalesce("replaces", F.lit(False)))


def external_missing(entries: DataFrame, library: DataFrame, track: str = "track") -> DataFrame:
    return entries.join(library.select(track).distinct(), track, "left_anti")


def collection(entries: DataFrame, order: Seq[str], track: str = "track") -> DataFrame:
    """Distinct tracks of a shelf with dense 1-based ids in the order they are first met."""
    firsts = entries.groupBy(track).agg(F.min(F.struct(*order)).alias("_first"))
    return positions(firsts, [], ["_first", track], "_at").rows.select(track, (F.col("_at") + 1).alias("key"))


def shelf_label(name: str = "name") -> Column:
    """A card label: the stem of a path, at most 22 characters."""
    text = F.when(col(name).contains("/") | col(name).contains("\\"), stem(name)).otherwise(col(name))
    return F.when(F.length(text) <= 22, text).otherwise(F.concat(F.substring(text, 1, 21), F.lit("…")))
