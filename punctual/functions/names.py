"""Readable stop names and destinations, as column expressions (no Python rows involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations in stop names
STOP_WORDS = {
    "SPFLD": "Springfield",
    "STA": "Station",
    "STN": "Station",
    "CTR": "Center",
    "MKTPL": "Marketplace",
    "HWY": "Hwy",
    "EUG": "Eugene",
}
# fixed values: compass letters
COMPASS = {
    "N": "north",
    "S": "south",
    "E": "east",
    "W": "west",
    "NE": "northeast",
    "NW": "northwest",
    "SE": "southeast",
    "SW": "southwest",
}
# fixed values: abbreviations and small words on destination signs
HEADSIGN_WORDS = {
    "SPFLD": "Springfield",
    "STA": "Station",
    "EUG": "Eugene",
    "MKTPL": "Marketplace",
    "CTR": "Center",
    "BR": "Bridge",
    "RD": "Rd",
    "TO": "to",
    "VIA": "via",
    "AND": "and",
    "AT": "at",
}
# fixed values: names left in capitals on destination signs
HEADSIGN_KEEP = ("UO", "LCC", "VRC", "EmX", "EMX")
# fixed values: words that join two halves of a sign
JOINERS = ("to", "via", "→")
# fixed values: the three shapes of "side of street" names; Java regular expressions
SIDE = r"(?i)^([NSEW])/\s?S\.?\s+of\s+"
CROSS_DIRECTION = SIDE + r"(.+?)\s+(NE|NW|SE|SW|N|S|E|W)\.?\s+of\s+(.+)$"
CROSS_AT = SIDE + r"(.+?)\s+(?:at|@|&|and)\s+(.+)$"
STREET_ONLY = SIDE + r"(.+)$"
# fixed values: names of those rules
RULE_DIRECTION = "side, street, direction of cross street"
RULE_AT = "side, street at cross street"
RULE_STREET = "side, street only"


def _lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for short, full in table.items():
        out = F.when(key == short, F.lit(full)).otherwise(out)
    return out


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _tidy(text: Column) -> Column:
    def word(w: Column) -> Column:
        key = F.upper(F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
        shouted = w.rlike(r"^\p{Lu}{4,}$")
        return _lookup(key, STOP_WORDS, F.when(shouted, _capitalised(w)).otherwise(w))

    return F.array_join(F.transform(_words(text), word), " ")


def stop_name_rule(name: Column) -> Column:
    """Which rule rewrites a stop name; null where none does."""
    raw = F.array_join(_words(name), " ")
    return (
        F.when(raw.rlike(CROSS_DIRECTION), RULE_DIRECTION)
        .when(raw.rlike(CROSS_AT), RULE_AT)
        .when(raw.rlike(STREET_ONLY), RULE_STREET)
    )


def clean_stop_name(name: Column) -> Column:
    raw = F.array_join(_words(name), " ")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(raw, pattern, group)

    def side(pattern: str) -> Column:
        return F.concat(F.lit(" ("), F.upper(part(pattern, 1)), F.lit(" side)"))

    direction = _lookup(F.upper(part(CROSS_DIRECTION, 3)), COMPASS, F.lit(""))
    return (
        F.when(name.isNull(), "")
        .when(
            raw.rlike(CROSS_DIRECTION),
            F.concat(
                _tidy(part(CROSS_DIRECTION, 2)),
                F.lit(" "),
                direction,
                F.lit(" of "),
                _tidy(part(CROSS_DIRECTION, 4)),
                side(CROSS_DIRECTION),
            ),
        )
        .when(
            raw.rlike(CROSS_AT),
            F.concat(
                _tidy(part(CROSS_AT, 2)), F.lit(" at "), _tidy(part(CROSS_AT, 3)), side(CROSS_AT)
            ),
        )
        .when(raw.rlike(STREET_ONLY), F.concat(_tidy(part(STREET_ONLY, 2)), side(STREET_ONLY)))
        .otherwise(_tidy(raw))
    )


def _sign_word(w: Column) -> Column:
    key = F.upper(w)
    shouted = (w == key) & w.rlike(r"\p{L}")
    plain = F.when(
        shouted, F.when(w.rlike(r"^\p{L}"), _capitalised(w)).otherwise(F.lower(w))
    ).otherwise(w)
    kept = F.when(key == "EMX", F.lit("EmX")).when(w.isin(*HEADSIGN_KEEP), w).otherwise(plain)
    return _lookup(key, HEADSIGN_WORDS, kept)


def _sign_words(words: Column) -> Column:
    """Each word on its own; the halves of "A/B" separately."""
    return F.transform(
        words, lambda w: F.array_join(F.transform(F.split(w, "/"), _sign_word), "/")
    )


def clean_headsign(headsign: Column, route: Column) -> Column:
    """A destination as people read it, without the route's own number."""
    text = headsign
    for mark in ("< >", "<>"):
        text = F.replace(text, F.lit(mark), F.lit(" → "))
    text = F.replace(text, F.lit("/ "), F.lit("/"))
    said = F.filter(_words(text), lambda w: ~w.isin("<", ">"))

    number = F.lower(route)
    named = number.isNotNull() & (number != "")
    numeric = number.rlike(r"^\d+$")

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"^0+(?=.)", "")

    def own(w: Column) -> Column:
        same_number = w.rlike(r"^\d+$") & numeric & (bare(w) == bare(number))
        return (F.lower(w) == number) | same_number

    without = F.when(named, F.filter(said, lambda w: ~own(w))).otherwise(said)
    internal = named & ~numeric & F.coalesce(F.get(without, F.lit(0)).rlike(r"^\d+$"), F.lit(False))
    without = F.when(internal, F.slice(without, 2, F.greatest(F.size(without), F.lit(1)))).otherwise(without)

    def keep(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        doubled = w.isin(*JOINERS) & F.coalesce(last.isin(*JOINERS), F.lit(False))
        swapped = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(w))
        return (
            F.when(doubled & (last == "→"), swapped)
            .when(doubled, acc)
            .otherwise(F.concat(acc, F.array(w)))
        )

    joined = F.array_join(
        F.aggregate(_sign_words(without), F.array().cast("array<string>"), keep), " "
    )
    dangling = "(?:" + "|".join((*JOINERS, "-")) + ")"
    joined = F.regexp_replace(joined, rf"^(?:{dangling}(?: |$))+", "")
    joined = F.regexp_replace(joined, rf"(?:(?:^| ){dangling})+$", "")
    whole = F.array_join(
        _sign_words(F.filter(_words(text), lambda w: ~w.isin("<", ">", "<>"))), " "
    )
    return F.when(headsign.isNull(), "").otherwise(F.when(joined != "", joined).otherwise(whole))
