"""Cleaners of an infobox's sections, as Columns: one projection a document, no shuffle.

A section is a map of texts; nested values are JSON texts. A missing section gives a struct of nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .schema import TEXT_MAP, _entry, is_nested, last_wins, let, value_of

# Fixed values.
CAPITAL_KEYS = ("Capital and largest city", "Capital", "Capital Administrative center", "Administrative center", "Administrative Centre", "Administrative capital", "Seat of government")
GOVERNMENT_KEYS = {
    "type": ("Government",),
    "legislature": ("Legislature",),
    "upper_house": ("Upper house",),
    "lower_house": ("Lower house",),
    "seat": ("Government seat",),
    "working_language": ("Working languages", "Working language"),
}
OFFICIAL_LANGUAGE_KEYS = ("Official languages", "Official language", "Official language and national language", "Official language (federal level)", "Co-official languages", "Common languages", "National language (official)", "Official languages and recognised national languages")
NATIONAL_LANGUAGE_KEYS = ("National language", "National languages", "Recognised national languages", "Recognized national languages")
TITLES = "president|prime.minister|minister|chancellor|king|queen|sultan|emir|sheikh|chief|vice|deputy|director|secretary|monarch|governor|commissioner|chairman|leader|captain|mayor|judge|justice|co.prince|representative|syndic|regent|premier|speaker|junta|general.secretary"
PLAIN_SECTIONS = ("General", "Government", "Area", "Population", "Economy", "Time", "Codes")
DATED = r"\b(?:[0-9]{3,4}\s*(?:BC|AD|CE|BCE)\b|1[0-9]{3}|20[0-2][0-9])"


def _texts(section: Column, holds) -> Column:
    """Entries of a section for which holds(key, value)."""
    return F.filter(F.map_entries(section), lambda e: holds(e["key"], e["value"]))


def _latest(entries: Column, year) -> Column:
    """The entry of the greatest year; of several, the last."""
    def of(dated: Column) -> Column:
        best = F.array_max(F.transform(dated, lambda d: d["year"]))
        return let(best, lambda top: F.try_element_at(F.filter(dated, lambda d: d["year"] == top), F.lit(-1)))["entry"]

    return let(F.transform(entries, lambda e: F.struct(year(e["key"]).alias("year"), e.alias("entry"))), of)


def _level(text: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(text, "(?i)(very high|high|medium|low)", 1), F.lit("")))


def _leading(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^([0-9.]+)", 1), F.lit("")).try_cast("double")


def capital(text: Column) -> Column:
    """A city's name without coordinates and what follows them."""
    city = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)\s+[0-9]+[°º].*$", ""), r"\s+Country:.*", ""))
    return F.nullif(city, F.lit(""))


def is_dated(value: Column) -> Column:
    """A text, or a JSON array of texts, with a year in it."""
    items = F.from_json(value, "array<string>")
    return F.coalesce(F.when(value.rlike(r"^\s*\["), (F.size(items) > 0) & F.forall(items, lambda i: i.rlike(DATED))).otherwise(~value.rlike(r"^\s*\{") & value.rlike(DATED)), F.lit(False))


def clean_area(s: Column) -> Column:
    """rank, total_km2, water_pct; without a total, of the first text with km in it."""
    total = F.coalesce(value_of(s, "Total", "Total area"), F.try_element_at(_texts(s, lambda k, v: ~is_nested(v) & F.contains(v, F.lit("km"))), F.lit(1))["value"])
    water = value_of(s, "Water (%)")
    none = water.isNull() | F.trim(water).rlike("(?i)^(negligible|none|n/?a)")
    return F.struct(T.world_rank(total).alias("rank"), T.first_number(total).alias("total_km2"), F.when(none, F.lit(0.0)).otherwise(F.coalesce(T.first_number(water), F.lit(0.0))).alias("water_pct"))


def clean_population(s: Column) -> Column:
    """density_per_km2, total and year of the latest count; a range gives its middle."""
    year = lambda k: F.nullif(F.regexp_extract(k, r"\b(20[0-9]{2})\b", 1), F.lit("")).cast("int")
    dated = _texts(s, lambda k, v: ~k.isin("Density", "Date format") & ~is_nested(v) & year(k).isNotNull())
    best = _latest(dated, year)
    plain = F.translate(F.trim(F.regexp_replace(best["value"], r"\s*\([^)]*\)", "")), "–−,", "--")
    span = r"(?i)^([0-9]+)\s*-\s*([0-9]+)\s*(million|billion)?"
    low, high = (F.nullif(F.regexp_extract(plain, span, k), F.lit("")).try_cast("double") for k in (1, 2))
    middle = (low + high) / 2 * F.when(F.lower(F.regexp_extract(plain, span, 3)) == "million", F.lit(1e6)).otherwise(F.lit(1.0))
    single = F.nullif(F.regexp_extract(plain, "([0-9]+)", 1), F.lit("")).try_cast("bigint")
    return F.struct(T.first_number(value_of(s, "Density")).alias("density_per_km2"), F.when(low.isNotNull(), middle.cast("bigint")).otherwise(single).alias("total"), year(best["key"]).alias("year"))


def clean_economy(s: Column) -> Column:
    """Currency code, both products, and the latest of each index with its level."""
    def product(key: str) -> Column:
        parts = F.from_json(value_of(s, key), TEXT_MAP)
        return F.struct(T.digits_only(value_of(parts, "Per capita")).alias("per_capita_usd"), T.billions(value_of(parts, "Total")).alias("total_billion_usd"), T.year_of(value_of(parts, "Details")).alias("year"))

    years = ("2024", "2023", "2022", "2021")
    hdi = value_of(s, *[f"HDI ({y})" for y in years])
    hdi_year = F.coalesce(*[F.when(value_of(s, f"HDI ({y})").isNotNull(), F.lit(int(y))) for y in years])
    of_key = lambda k: F.coalesce(T.year_of(k), F.lit(0))
    gini = _latest(_texts(s, lambda k, v: k.startswith("Gini") & ~is_nested(v)), of_key)
    currency = value_of(s, "Currency")
    codes = F.regexp_extract_all(currency, F.lit(r"\(\s*([A-Z]{3})\s*\)"), F.lit(1))
    return F.struct(
        F.coalesce(F.try_element_at(codes, F.lit(-1)), F.nullif(F.trim(currency), F.lit(""))).alias("currency_code"),
        product("GDP (nominal)").alias("gdp_nominal"),
        product("GDP ( PPP )").alias("gdp_ppp"),
        F.struct(_level(gini["value"]).alias("category"), _leading(gini["value"]).alias("value"), F.nullif(of_key(gini["key"]), F.lit(0)).alias("year")).alias("gini"),
        F.struct(_level(hdi).alias("category"), T.world_rank(hdi).alias("rank"), _leading(hdi).alias("value"), hdi_year.alias("year")).alias("hdi"),
    )


def clean_time(s: Column) -> Column:
    return F.struct(T.utc_offset(value_of(s, "Summer ( DST )")).alias("timezone_dst"), T.utc_offset(value_of(s, "Time zone")).alias("timezone_utc"))


def clean_codes(s: Column) -> Column:
    calling, domain = value_of(s, "Calling code"), value_of(s, "Internet TLD")
    first = F.nullif(F.trim(F.regexp_extract(calling, r"(\+[0-9\s]+)", 1)), F.lit(""))
    return F.struct(F.coalesce(first, F.nullif(F.trim(calling), F.lit(""))).alias("calling_code"), F.nullif(F.regexp_extract(domain, r"(\.\S+)", 1), F.lit("")).alias("internet_tld"), value_of(s, "ISO 3166 code").alias("iso_3166_code"))


def shares(value: Column) -> Column:
    """Group to percentage of a JSON object of texts or of objects with a percentage; null where a value has no number."""
    m = F.from_json(value, TEXT_MAP)
    return F.when(value.rlike(r"^\s*\{"), F.transform_values(m, lambda _, v: T.percent(F.when(is_nested(v), value_of(F.from_json(v, TEXT_MAP), "percentage")).otherwise(v))))


def _shares_of(s: Column, prefix: str) -> Column:
    of_key = lambda k: F.coalesce(T.year_of(k), F.lit(0))
    latest = _latest(_texts(s, lambda k, _: k.startswith(prefix)), of_key)
    return F.struct(shares(latest["value"]).alias("groups"), F.nullif(of_key(latest["key"]), F.lit(0)).alias("year"), F.when(~is_nested(latest["value"]), F.trim(latest["value"])).alias("note"))


def clean_general(s: Column) -> Column:
    """Cities, demonym, languages, and shares of the latest year; a combined key gives the capital and the largest city."""
    cap = capital(value_of(s, *CAPITAL_KEYS))
    demonym = value_of(s, "Demonym", "Demonyms")
    national = value_of(s, *NATIONAL_LANGUAGE_KEYS)
    return F.struct(
        cap.alias("capital"),
        F.coalesce(capital(value_of(s, "Largest city")), cap).alias("largest_city"),
        F.when(demonym.rlike(r"^\s*\["), F.try_element_at(F.from_json(demonym, "array<string>"), F.lit(1))).otherwise(demonym).alias("demonym"),
        F.coalesce(value_of(s, *OFFICIAL_LANGUAGE_KEYS), national).alias("official_language"),
        national.alias("national_language"),
        _shares_of(s, "Ethnic").alias("ethnic_groups"),
        _shares_of(s, "Religion").alias("religion"),
    )


def _government_rest(s: Column) -> Column:
    known = [k for keys in GOVERNMENT_KEYS.values() for k in keys]
    return F.map_filter(s, lambda k, _: ~k.isin(*known))


def rescued_leaders(infobox: Column) -> Column:
    """Entries of leaders that stand inside other sections: by title, with a value that is no date."""
    skipped = ("Government", "General", "History", "Area", "Population", "Time", "Codes")
    other = F.filter(F.map_entries(infobox), lambda e: ~e["key"].isin(*skipped))
    nested = F.flatten(F.transform(other, lambda e: F.filter(F.map_values(e["value"]), lambda v: v.rlike(r"^\s*\{"))))
    pairs = F.flatten(F.transform(nested, lambda v: F.map_entries(F.from_json(v, TEXT_MAP))))
    return F.transform(F.filter(pairs, lambda e: e["key"].rlike("(?i)" + TITLES) & ~is_dated(e["value"])), lambda e: _entry(T.snake_case(e["key"]), e["value"]))


def clean_government(infobox: Column) -> Column:
    """Structure and leaders; dates found among them belong to history. Leaders of the section itself come before rescued ones."""
    s = F.try_element_at(infobox, F.lit("Government"))
    own = F.transform(_texts(_government_rest(s), lambda _, v: ~is_dated(v)), lambda e: _entry(T.snake_case(e["key"]), e["value"]))
    none = F.array().cast("array<struct<key:string,value:string>>")
    leaders = last_wins(F.concat(F.coalesce(rescued_leaders(infobox), none), F.coalesce(own, none)))
    return F.struct(*[value_of(s, *keys).alias(name) for name, keys in GOVERNMENT_KEYS.items()], leaders.alias("leaders"))


def clean_history(infobox: Column) -> Column:
    """Event to date: the dates of the government section, then all sections that are no plain ones; the first value of an event counts."""
    own = _texts(_government_rest(F.try_element_at(infobox, F.lit("Government"))), lambda _, v: is_dated(v))
    other = F.flatten(F.transform(F.filter(F.map_entries(infobox), lambda e: ~e["key"].isin(*PLAIN_SECTIONS)), lambda e: F.map_entries(e["value"])))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return last_wins(F.reverse(F.concat(F.coalesce(own, none), F.coalesce(other, none))))


def clean_infobox(infobox: Column) -> Column:
    """A struct of all cleaned sections of a map of section names to sections."""
    def of(box: Column) -> Column:
        clean = lambda name, cleaner: let(F.try_element_at(box, F.lit(name)), cleaner)
        return F.struct(
            clean("Area", clean_area).alias("area"),
            clean("Codes", clean_codes).alias("codes"),
            clean("Economy", clean_economy).alias("economy"),
            clean("General", clean_general).alias("general"),
            clean_government(box).alias("government"),
            clean_history(box).alias("history"),
            clean("Population", clean_population).alias("population"),
            clean("Time", clean_time).alias("time"),
        )

    return let(infobox, of)
