"""Names, compositions and numbers of scraped fields brought to one form, as Columns.

Values are texts; a nested value is its JSON text, as from_json leaves it in a map of texts. Null gives null, or an
empty map where a map is built. Where a label occurs again, its last value counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_spaces, compare_text

TEXT_MAP = "map<string,string>"
ENTRIES = "array<struct<key:string,value:string>>"
SIGNED = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)"

# Names of keys (in lower case) that mean the same.
KEY_NAMES = {
    "Demonyms": ("demonym", "demonyms"),
    "Official languages": ("official language", "official languages", "official language and national language", "official languages and national language"),
    "Official regional languages": ("recognized regional languages", "recognised regional languages"),
    "Recognized national languages": ("recognized national languages", "recognised national languages"),
    "Recognized minority languages": ("recognized minority languages", "recognised minority languages"),
    "National languages": ("national language", "national languages"),
    "Capital": ("capital and largest city",),
    "Government seat": ("government seat",),
    "Federal city": ("federal city",),
    "Largest city": ("largest city",),
    "Ethnic Groups": ("nationality", "ethnicity", "ethnic groups", "ethnic group", "ethnic groups / nationality"),
    "Religions": ("religion", "religions"),
    "GDP PPP": ("gdp ppp",),
    "GDP Nominal": ("gdp nominal",),
    "Government type": ("government type",),
    "Government structure": ("government structure",),
}
# Keys with a remark in parentheses, which come before the names above.
KEY_PATTERNS = {
    "GDP (PPP)": r"^gdp\s*\(\s*ppp\s*\)?$",
    "GDP (nominal)": r"^gdp\s*\(\s*nominal\s*\)?$",
    "Water (%)": r"^water\s*\(%\)?$",
    "Religion": r"^religion\s*\([^)]*\)$",
    "Ethnic groups": r"^ethnic groups\s*\([^)]*\)$",
    "Gini": r"^gini\s*\([^)]*\)$",
    "HDI": r"^hdi\s*\([^)]*\)$",
    "Countries (non-sovereign parts)": r"^countries \(non",
}
# Words that are no language.
LANGUAGE_NOISE = ("and", "or", "de", "la", "le", "official", "regional", "recognized", "recognised", "minority", "national", "language", "languages", "locally")
# Chambers by what they are called.
CHAMBERS = {
    "Upper house": ("bundesrat", "council of states", "federal council", "senate", "house of lords"),
    "Lower house": ("bundestag", "national council", "house of commons", "house of representatives", "national assembly"),
}
# Names of religions (in lower case) and parts of names, in the order they are tried.
RELIGION_NAMES = {
    "Christianity": ("christianity", "christian", "catholic", "orthodox", "armenian apostolic", "protestant", "other christians"),
    "Islam": ("islam", "muslim", "sunni", "shia", "shi'a", "shia islam", "alawite"),
    "No religion": ("no religion", "irreligion", "agnostic", "atheist", "atheism"),
    "Other": ("druze", "jewish", "judaism", "other", "other religions"),
}
RELIGION_PARTS = {"Christianity": "christ|cathol|orthodox|protest", "Islam": "islam|muslim|sunni|shia|alawite", "No religion": "no religion|irrelig|athe|agnostic"}
# Names that state a bucket's share as a whole.
WHOLE_NAMES = {"Christianity": ("christianity",), "Islam": ("islam",), "No religion": ("no religion", "irreligion"), "Other": ("other", "other religions")}
# Fixed values.
MULTIPLIERS = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
LANGUAGE_KINDS = {"Official": "Official languages", "Regional": "Official regional languages", "Recognized national": "Recognized national languages", "Recognized minority": "Recognized minority languages", "National": "National languages", "Vernacular": "Local vernacular"}
DETAIL_KEYS = ("Federal city", "Largest city", "Government seat", "Countries (non-sovereign parts)")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _first_of(cases: list[Column]) -> Column:
    return F.coalesce(*cases)


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.cast("string").alias("value"))


def last_wins(entries: Column) -> Column:
    """A map of (key, value) entries in order of first occurrence, with the last value of each key."""
    def gather(all_entries: Column) -> Column:
        keys = F.array_distinct(F.transform(all_entries, lambda e: e["key"]))
        return F.transform(keys, lambda k: _entry(k, F.element_at(F.filter(all_entries, lambda e: e["key"] == k), -1)["value"]))

    return F.coalesce(F.map_from_entries(let(entries, gather)), F.create_map().cast(TEXT_MAP))


def value_of(fields: Column, *keys: str) -> Column:
    """The first of several keys' values that is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])


def is_nested(value: Column) -> Column:
    return value.rlike(r"^\s*[{\[]")


# numbers


def signed_number(text: Column) -> Column:
    """The first number with its sign, thousands separators removed."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, SIGNED, 1), F.lit("")), ",", "").try_cast("double")


def _multiple(word: Column) -> Column:
    return reduce(lambda rest, m: F.when(word == m[0], F.lit(m[1])).otherwise(rest), reversed(MULTIPLIERS.items()), F.lit(None).cast("double"))


def share(text: Column) -> Column:
    """A percentage's or area's number; negligible is 0."""
    low = compare_text(text)
    return F.when(F.contains(low, F.lit("negligible")), F.lit(0.0)).otherwise(signed_number(low))


def money(text: Column) -> Column:
    """The first number, times the smallest multiplier word that the text holds."""
    low = compare_text(text)
    times = _first_of([F.when(F.contains(low, F.lit(w)), F.lit(m)) for w, m in MULTIPLIERS.items()] + [F.lit(1.0)])
    return signed_number(low) * times


def per_km(text: Column) -> Column:
    """A density: the number in front of km, else the first one."""
    low = compare_text(text)
    return F.coalesce(signed_number(F.regexp_extract(low, SIGNED + r"\s*/?\s*km", 1)), signed_number(low))


def head_count(text: Column) -> Column:
    """A population: of a range with a multiplier word the low bound, else the number with such a word, else the first."""
    low = compare_text(text)
    words = "(" + "|".join(MULTIPLIERS) + ")"
    n = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    ranged, plain = n + r"\s*-\s*" + n + r"\s*" + words, n + r"\s*" + words
    of = lambda pattern, word: signed_number(F.regexp_extract(low, pattern, 1)) * _multiple(F.regexp_extract(low, pattern, word))
    return F.coalesce(of(ranged, 3), of(plain, 2), signed_number(low))


# keys and codes


def canonical_key(key: Column) -> Column:
    """One name for the variants of a key; others stay, with their blanks collapsed."""
    def of(k: Column) -> Column:
        dated = [F.when(k["low"].rlike(p), F.lit(name)) for name, p in KEY_PATTERNS.items()]
        named = [F.when(k["low"].isin(*variants), F.lit(name)) for name, variants in KEY_NAMES.items()]
        return _first_of([*dated, *named, k["plain"]])

    return let(let(collapse_spaces(key), lambda k: F.struct(k.alias("plain"), F.lower(k).alias("low"))), of)


def is_url_like(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike("^https?://") | F.contains(low, F.lit("www."))


def is_code_like(path: Column) -> Column:
    """By the path of a value: codes, domains, time zones and the like."""
    low = F.lower(F.array_join(path, " / "))
    return low.rlike("code|tld|utc|timezone|time zone") | F.lower(F.element_at(path, -1)).isin("date format", "driving side")


def word_tokens(text: Column) -> Column:
    """Words in lower case, parted at changes of case, underscores, slashes, dashes and other marks."""
    parted = F.regexp_replace(collapse_spaces(text), "([a-z])([A-Z])", "$1 $2")
    words = F.split(F.lower(F.regexp_replace(parted, r"(?U)[^\w\s]|_", " ")), r"\s+")
    return F.coalesce(F.filter(words, lambda w: w != ""), F.array().cast("array<string>"))


# compositions


def language_label(text: Column) -> Column:
    """A language's name without remarks, percentages and leading conjunctions."""
    t = F.regexp_replace(collapse_spaces(text), r"\([^)]*\)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[0-9][0-9.,]*\s*%.*$", ""), r"(?i)^(?:and|or)\s+", "")
    return collapse_spaces(F.regexp_replace(t, "^[ ,;:/]+|[ ,;:/]+$", ""))


def without_contained(items: Column) -> Column:
    """Distinct items that no other, different item contains, letters without case. Square in the items of one field."""
    pairs = F.transform(items, lambda i: F.struct(i.alias("item"), F.lower(i).alias("low")))
    alone = let(pairs, lambda ps: F.filter(ps, lambda i: ~F.exists(ps, lambda o: (o["low"] != i["low"]) & F.contains(o["low"], i["low"]))))
    return F.array_distinct(F.transform(alone, lambda p: p["item"]))


def language_items(text: Column) -> Column:
    parts = F.split(collapse_spaces(text), r"(?i)\s*[,;/]\s*|\s+and\s+|\s+or\s+")
    labels = F.filter(F.transform(parts, language_label), lambda t: (t != "") & ~F.lower(t).isin(*LANGUAGE_NOISE))
    return without_contained(labels)


def _present(items: Column) -> Column:
    return F.transform(items, lambda i: _entry(i, F.lit("present")))


def _named_shares(text: Column) -> Column:
    parts = F.filter(F.split(collapse_spaces(text), r"\s*[,;/]\s*"), lambda p: F.contains(p, F.lit("%")))
    pairs = F.transform(parts, lambda p: _entry(language_label(p), F.concat(share(p).cast("string"), F.lit("%"))))
    return F.filter(pairs, lambda e: (e["key"] != "") & e["value"].isNotNull())


def _entries(value: Column, label, of_text, of_item) -> Column:
    """Entries of a value that may be a text, a JSON object or a JSON array of texts and objects."""
    def of_object(v: Column) -> Column:
        pairs = F.transform(F.map_entries(F.from_json(v, TEXT_MAP)), lambda e: _entry(label(e["key"]), e["value"]))
        return F.filter(pairs, lambda e: e["key"] != "")

    of_list = F.flatten(F.transform(F.from_json(value, "array<string>"), lambda i: F.when(i.rlike(r"^\s*\{"), of_object(i)).otherwise(of_item(i))))
    found = F.when(value.rlike(r"^\s*\{"), of_object(value)).when(value.rlike(r"^\s*\["), of_list).otherwise(of_text(value))
    return F.coalesce(found, F.array().cast(ENTRIES))


def language_composition(value: Column) -> Column:
    """Language to its share, or to present. A text with percentages gives those parts that have one."""
    def of_text(v: Column) -> Column:
        return let(_named_shares(v), lambda shares: F.when(F.size(shares) > 0, shares).otherwise(_present(language_items(v))))

    return last_wins(_entries(value, language_label, of_text, lambda i: _present(language_items(i))))


def population_composition(value: Column) -> Column:
    """Group to its value, or to present."""
    def of_text(v: Column) -> Column:
        parts = F.split(collapse_spaces(v), r"(?i)\s*[,;/]\s*|\s+and\s+|\s+or\s+")
        return _present(F.filter(F.transform(parts, collapse_spaces), lambda p: p != ""))

    def of_item(i: Column) -> Column:
        return F.filter(_present(F.array(collapse_spaces(i))), lambda e: e["key"] != "")

    return last_wins(_entries(value, collapse_spaces, of_text, of_item))


def religion_bucket(label: Column) -> Column:
    """Christianity, Islam, No religion or Other, by name, else by part of the name."""
    def of(low: Column) -> Column:
        named = [F.when(low.isin(*names), F.lit(b)) for b, names in RELIGION_NAMES.items()]
        parts = [F.when(low.rlike(p), F.lit(b)) for b, p in RELIGION_PARTS.items()]
        return _first_of([*named, *parts, F.lit("Other")])

    return let(compare_text(label), of)


def states_whole(label: Column) -> Column:
    low = compare_text(label)
    return low.isin(*[n for names in WHOLE_NAMES.values() for n in names])


def religion_composition(value: Column) -> Column:
    """Bucket to percentage: what a bucket's own name states, else the sum of the labels in it."""
    of_text = lambda v: F.transform(F.split(v, r"\s*[,;/]\s*"), lambda p: _entry(p, p))
    entries = _entries(value, lambda k: k, of_text, lambda i: F.array(_entry(i, i)))
    typed = F.transform(entries, lambda e: F.struct(religion_bucket(e["key"]).alias("bucket"), states_whole(e["key"]).alias("whole"), share(e["value"]).alias("n")))

    def gathered(numbers: Column) -> Column:
        def of_bucket(b: str) -> Column:
            own = F.filter(numbers, lambda e: e["bucket"] == b)
            rest = F.filter(own, lambda e: ~e["whole"])
            total = F.when(F.size(rest) > 0, F.aggregate(rest, F.lit(0.0), lambda acc, e: acc + e["n"]))
            return F.coalesce(F.try_element_at(F.filter(own, lambda e: e["whole"]), F.lit(-1))["n"], total)

        return F.array(*[_entry(F.lit(b), F.concat(of_bucket(b).cast("string"), F.lit("%"))) for b in RELIGION_NAMES])

    pairs = let(F.filter(typed, lambda e: e["n"].isNotNull()), gathered)
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def legislature_roles(text: Column) -> Column:
    """The text as Legislature; the chamber of the longest name found has the whole text, another one its own name."""
    by_length = sorted(((n, role) for role, names in CHAMBERS.items() for n in names), key=lambda c: -len(c[0]))

    def of(raw: Column) -> Column:
        found = lambda name: F.nullif(F.regexp_extract(raw, rf"(?i)\b({name})\b", 1), F.lit(""))
        first = _first_of([F.when(found(n).isNotNull(), F.lit(role)) for n, role in by_length])
        chambers = [_entry(F.lit(r), F.when(first == r, raw).otherwise(_first_of([found(n) for n, role in by_length if role == r]))) for r in CHAMBERS]
        return F.array(_entry(F.lit("Legislature"), raw), *chambers)

    return F.map_from_entries(F.filter(let(collapse_spaces(text), of), lambda e: e["value"].isNotNull()))


# sections


def government_fields(section: Column) -> Column:
    """A map of government fields under their canonical keys, a legislature's text split by chamber."""
    split = lambda e: (e["key"] == "Legislature") & ~is_nested(e["value"])

    def of(renamed: Column) -> Column:
        roles = F.flatten(F.transform(F.filter(renamed, split), lambda e: F.map_entries(legislature_roles(e["value"]))))
        stated = F.filter(renamed, lambda e: ~split(e))
        return F.concat(F.filter(roles, lambda e: ~F.exists(stated, lambda s: s["key"] == e["key"])), stated)

    return last_wins(let(F.transform(F.map_entries(section), lambda e: _entry(canonical_key(e["key"]), e["value"])), of))


def general_fields(section: Column) -> Column:
    """A struct of maps: fields under canonical keys, languages by kind, population and religion compositions."""
    moved = (*DETAIL_KEYS, *LANGUAGE_KINDS.values(), "Population composition", "Religion")

    def of(renamed: Column) -> Column:
        at = lambda k: F.try_element_at(renamed, F.lit(k))
        kinds = F.array(*[F.struct(F.lit(kind).alias("key"), F.when(at(k).isNotNull(), language_composition(at(k))).alias("value")) for kind, k in LANGUAGE_KINDS.items()])
        return F.struct(
            F.map_filter(renamed, lambda k, _: ~k.isin(*moved)).alias("fields"),
            F.map_from_entries(F.filter(kinds, lambda e: e["value"].isNotNull())).alias("languages"),
            F.when(at("Population composition").isNotNull(), population_composition(at("Population composition"))).alias("population"),
            F.when(at("Religion").isNotNull(), religion_composition(at("Religion"))).alias("religion"),
        )

    return let(last_wins(F.transform(F.map_entries(section), lambda e: _entry(canonical_key(e["key"]), e["value"]))), of)


# numeric fields by path


def numeric_field(path: Column, text: Column) -> Column:
    """A struct of the field that a value at a path belongs to and its number; null where it is no number.

    A bare number at any other path is a field of its own, auto::<path>.
    """
    return let(_place(path, text), lambda p: _by_rules(_rules(p), p["text"]))


def numeric_field_by_words(path: Column, text: Column) -> Column:
    """The earlier rules: by words anywhere in the path, and no field for bare numbers elsewhere."""
    return let(_place(path, text), lambda p: _by_rules(_rules_by_words(p), p["text"]))


def _place(path: Column, text: Column) -> Column:
    steps = F.transform(path, lambda p: F.lower(p))
    return let(steps, lambda low: F.struct(F.try_element_at(low, F.lit(1)).alias("top"), F.try_element_at(low, F.lit(-1)).alias("leaf"), F.array_join(low, " / ").alias("joined"), collapse_spaces(text).alias("text")))


def _rules(place: Column) -> list:
    top, leaf = place["top"], place["leaf"]
    gdp = top.isin("gdp ppp", "gdp nominal", "gdp (ppp)", "gdp (nominal)")
    rules = [(F.lit(f"area_{kind}"), (top == "area") & (leaf == f"{kind}_km2"), share) for kind in ("total", "land", "water")]
    rules += [
        (F.lit("percentage"), (top == "area") & (leaf == "water (%)"), share),
        (F.lit("population"), (top == "population") & leaf.rlike("^total$|estimate|census|^population$"), head_count),
        (F.lit("density"), (top == "population") & F.contains(leaf, F.lit("density")), per_km),
        (F.lit("gdp_total"), gdp & (leaf == "total"), money),
        (F.lit("gdp_per_capita"), gdp & leaf.isin("per_capita", "per capita"), money),
        (F.lit("gini"), (top == "gini") | (leaf == "gini"), signed_number),
        (F.lit("hdi"), (top == "hdi") | (leaf == "hdi"), signed_number),
        (F.lit("percentage"), top.isin("religions", "religion", "ethnic groups", "population composition", "language composition"), share),
        (F.concat(F.lit("auto::"), place["joined"]), (place["joined"] != "") & place["text"].rlike("^" + SIGNED + "$"), signed_number),
    ]
    return rules


def _rules_by_words(place: Column) -> list:
    joined, leaf = place["joined"], place["leaf"]
    gdp = joined.rlike(r"gdp \(ppp\)|gdp \(nominal\)")
    people = F.contains(joined, F.lit("population"))
    return [
        (F.lit("percentage"), (leaf == "water (%)") | joined.rlike("religion|population composition|language composition"), share),
        (F.lit("gdp_total"), gdp & (leaf == "total"), money),
        (F.lit("gdp_per_capita"), gdp & (leaf == "per capita"), money),
        (F.lit("area_total"), F.contains(joined, F.lit("area")) & (leaf == "total"), share),
        (F.lit("density"), people & F.contains(leaf, F.lit("density")), per_km),
        (F.lit("population"), people & leaf.rlike("estimate|census|^population$|^total$"), head_count),
        (F.lit("gini"), leaf == "gini", signed_number),
        (F.lit("hdi"), leaf == "hdi", signed_number),
    ]


def _by_rules(rules: list, text: Column) -> Column:
    """The first rule that holds and finds a number."""
    read = lambda name, parse: let(parse(text), lambda n: F.when(n.isNotNull(), F.struct(name.alias("field"), n.alias("number"))))
    return _first_of([F.when(holds, read(name, parse)) for name, holds, parse in rules])
