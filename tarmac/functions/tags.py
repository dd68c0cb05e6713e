"""Tag readings: normalised text, numbers, class ladders and three-valued flags.

A flag of an absent tag is false where the row exists and null where it does not.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surface classes, track grades, ranks and one-way vocabulary of road tags.
SURFACE_CLASSES: dict[str, tuple[str, ...]] = {
    "paved": ("asphalt", "paved", "chipseal", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "bricks"),
    "compacted": ("compacted", "fine_gravel"),
    "gravel": ("gravel", "pebblestone", "rock", "unpaved"),
    "soil": ("dirt", "ground", "earth", "mud", "sand", "grass", "woodchips"),
    "cobblestone": ("sett", "cobblestone", "unhewn_cobblestone"),
}
TRACK_GRADES: dict[str, str] = {"grade1": "paved", "grade2": "gravel", "grade3": "gravel", "grade4": "soil", "grade5": "soil"}
HIGHWAY_RANK: dict[str, int] = {
    "motorway": 6, "motorway_link": 6, "trunk": 5, "trunk_link": 5, "primary": 4, "primary_link": 4, "secondary": 3, "secondary_link": 3,
    "tertiary": 2, "tertiary_link": 2, "unclassified": 1, "residential": 1, "living_street": 1, "service": 1,
}
ONEWAY_FORWARD, ONEWAY_BACKWARD, ONEWAY_BOTH = ("yes", "true", "1"), ("-1", "reverse"), ("no", "false", "0")
ONEWAY_JUNCTIONS = ("roundabout", "circular")
COUNT_KINDS: dict[str, str] = {
    "traffic_signals": "signal", "crossing": "crossing", "stop": "stop", "give_way": "stop", "level_crossing": "level_crossing",
    "railway_crossing": "level_crossing", "barrier": "barrier", "traffic_calming": "barrier",
}
# What counts as a bridge or a tunnel, kinds read as a signal near one, and codes of accident parties.
BRIDGES = ("yes", "viaduct", "cantilever", "covered", "suspension_bridge", "boardwalk")
TUNNELS = ("yes", "avalanche_protector")
SIGNAL_KINDS = ("traffic_signals", "crossing")
PARTY_CODES: dict[str, str] = {"51": "bicycle", "52": "power_assisted_bicycle"}


def normalized(value: Column) -> Column:
    """Trimmed lower case; empty text is absent."""
    text = F.lower(F.trim(value))
    return F.when(text != "", text)


def positive_int(value: Column) -> Column:
    """The whole part of a plain decimal number above zero; null for anything else."""
    text = F.trim(value)
    number = F.floor(text.try_cast("double"))
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$") & (number > 0) & (number <= 2_147_483_647), number.cast("int"))


def first_match(value: Column, classes: Mapping[str, Iterable[str]], other: str | None = None) -> Column:
    """The first class that has the value; ``other`` for further values; null stays null."""
    items = list(classes.items())
    out = F.when(value.isin(*items[0][1]), items[0][0])
    for name, values in items[1:]:
        out = out.when(value.isin(*values), name)
    return out if other is None else out.when(value.isNotNull(), other)


def surface_class(surface: Column) -> Column:
    return first_match(normalized(surface), SURFACE_CLASSES, "other")


def surface_estimate(surface: Column, tracktype: Column, highway: Column) -> Column:
    """Surface class, else the track grade's, else unknown by kind of road; a surface of no class counts as none."""
    grade = first_match(normalized(tracktype), {c: [g for g, k in TRACK_GRADES.items() if k == c] for c in dict.fromkeys(TRACK_GRADES.values())})
    unknown = F.when(normalized(highway) == "track", "unknown_track").when(highway.isNotNull(), "unknown_road")
    return F.coalesce(first_match(normalized(surface), SURFACE_CLASSES), grade, unknown)


def absent_is_false(row_exists: Column, condition: Column) -> Column:
    """A condition on tags: false if they are absent, null if there is no row."""
    return F.when(row_exists, F.coalesce(condition, F.lit(False)))


def any_of(values: Iterable[Column], wanted: Iterable[str]) -> Column:
    """Whether any column has one of the wanted values; nulls are no match."""
    wanted = list(wanted)
    return F.coalesce(F.exists(F.array(*values), lambda v: v.isin(*wanted)), F.lit(False))


def cycleway_class(tags: Iterable[Column], highway: Column, bicycle: Column) -> Column:
    """The most separate kind among the cycleway tags; a path for walkers that bicycles may use is shared."""
    tags = list(tags)
    path = highway.isin("footway", "path") & bicycle.isin("yes", "designated")
    return F.when((highway == "cycleway") | any_of(tags, ["track"]), "separated").when(any_of(tags, ["lane"]), "lane").when(any_of(tags, ["share_busway", "shared_lane"]) | path, "shared")


def highway_rank(highway: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in HIGHWAY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, highway), F.lit(0))


def count_kind(kind: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in COUNT_KINDS.items() for x in pair])
    return F.try_element_at(kinds, kind)


def stop_kind(kind: Column, near_signal: Column) -> Column:
    """The kind that a point is shown and counted as: a crossing near a signal is that signal."""
    return F.when(F.coalesce(near_signal, F.lit(False)) & kind.isin(*SIGNAL_KINDS), "traffic_signals").otherwise(kind)


def is_bridge(row_exists: Column, bridge: Column) -> Column:
    return absent_is_false(row_exists, normalized(bridge).isin(*BRIDGES))


def is_tunnel(row_exists: Column, tunnel: Column) -> Column:
    return absent_is_false(row_exists, normalized(tunnel).isin(*TUNNELS))


def is_signal(highway: Column, crossing: Column) -> Column:
    """A signal by the raw tags, which are not normalised here."""
    return F.coalesce((highway == "traffic_signals") | ((highway == "crossing") & F.contains(F.coalesce(crossing, F.lit("")), F.lit("signals"))), F.lit(False))


def one_way(direction: Column) -> Column:
    return direction != "both"


def travel_allowed(direction: Column) -> tuple[Column, Column]:
    """Whether a road may be ridden along its line, and against it."""
    return direction != "backward", direction != "forward"


def party_type(code: Column) -> Column:
    """The kind of an accident's party; codes of no kind are other, and no code is none."""
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PARTY_CODES.items() for x in pair]), code), F.lit("other")))


def involves_bicycle(*parties: Column) -> Column:
    return any_of(parties, PARTY_CODES.values())


def is_fatal(deaths: Column) -> Column:
    return F.coalesce(deaths, F.lit(0)) > 0


def travel_direction(oneway_bicycle: Column, oneway: Column, junction: Column) -> Column:
    """``both``, ``forward`` or ``backward``: the bicycle rule, then the general one, then roundabouts."""

    def read(value: Column) -> Column:
        return F.when(value.isin(*ONEWAY_FORWARD), "forward").when(value.isin(*ONEWAY_BACKWARD), "backward").when(value.isin(*ONEWAY_BOTH), "both")

    return F.coalesce(read(oneway_bicycle), read(oneway), F.when(junction.isin(*ONEWAY_JUNCTIONS), "forward"), F.lit("both"))


def per_km(count: Column, distance_m: Column) -> Column:
    return F.try_divide(count, distance_m / 1000.0)


def per_km_year(count: Column, distance_m: Column, years: Column) -> Column:
    return F.when(years > 0, F.try_divide(count, distance_m / 1000.0 * years))


def accident_weight(deaths: Column) -> Column:
    """Fatal accidents count three times."""
    return F.when(F.coalesce(deaths, F.lit(0)) > 0, 3.0).otherwise(1.0)


def directed(forward: Column, value: Column, partner: Column, negate: bool = False) -> Column:
    """A value of an undirected segment as seen in one direction."""
    return F.when(forward, value).otherwise(-partner if negate else partner)


def tile_boolean(value: Column) -> Column:
    """True or absent: tiles carry no false."""
    return F.when(value, F.lit(True))


def tile_number(value: Column, digits: int) -> Column:
    """Rounded half away from zero; zero is absent."""
    return F.nullif(F.round(value.cast("double"), digits), F.lit(0.0))


def matches_rules(rules: Iterable[Mapping[str, Iterable[str]]]) -> Column:
    """Whether any rule holds: all its tags present, with an allowed value (``*`` allows all)."""
    out = F.lit(False)
    for rule in rules:
        held = F.lit(True)
        for tag, allowed in rule.items():
            value = F.try_element_at(F.col("tags"), F.lit(tag))
            held = held & (value.isNotNull() if "*" in allowed else F.coalesce(value.isin(*allowed), F.lit(False)))
        out = out | held
    return out
