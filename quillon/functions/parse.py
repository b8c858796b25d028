"""Parsers of answers and texts, as Columns: numbers, times, dates, letters, yes or no, slots, templates, Markdown, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Words of numbers, of agreement, and the slots that words ask for, in the order in which they are tried.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
YES, NO = ("yes", "yeah", "yep", "true", "correct", "right"), ("no", "nope", "false", "incorrect", "wrong", "not")
MONTHS = "january february march april may june july august september october november december".split()
SLOTS = (("time", r"\b(when|time|hour|day)\b"), ("place", r"\b(where|place|city|in the)\b"), ("person", r"\b(who|whom|whose|he|she)\b"), ("count", r"\b(how many|number|count|of the)\b"), ("reason", r"\b(why|because|reason)\b"))


def slot(question: Column, slots: tuple = SLOTS) -> Column:
    """The first slot whose words the question has; none without any."""
    out, lower = None, F.lower(question)
    for name, pattern in slots:
        out = F.when(lower.rlike(pattern), name) if out is None else out.when(lower.rlike(pattern), name)
    return out.otherwise("none")


# What is a date or a time of day, and no number; how often, in words; minutes of an hour, in words.
_HOURS = "|".join(sorted(UNITS[1:13], key=len, reverse=True))
DATE_FORMS = (r"\b\d{4}-\d{2}-\d{2}\b", rf"\b(?:{'|'.join(MONTHS)})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?\b", rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{'|'.join(MONTHS)})(?:\s+\d{{4}})?\b")
HOW_OFTEN = {"once": 1.0, "twice": 2.0, "thrice": 3.0}
PARTS = {"half": 30, "quarter": 15, "five": 5, "ten": 10, "twenty": 20, "twenty-five": 25}
PHRASE = rf"\b({'|'.join(sorted(PARTS, key=len, reverse=True))}|\d{{1,2}})(?:\s+minutes?)?\s+(past|to)\s+(\d{{1,2}}|{_HOURS})\b(?:\s*([ap])\.?m\b)?"
CLOCK, BARE = r"\b(\d{1,2}):(\d{2})(?:\s*([ap])\.?m\b)?", r"\b(\d{1,2})\s*([ap])\.?m\b"


def _plain(pattern: str) -> str:
    """The pattern with its groups as groups that capture nothing."""
    return re.sub(r"\((?!\?)", "(?:", pattern)


TIME_FORMS = (_plain(PHRASE), _plain(CLOCK), _plain(BARE), r"\bnoon\b", r"\bmidnight\b")


def numbers(text: Column) -> Column:
    """All numbers in order: digits (with sign, thousands separators and decimals), words from zero to ninety-nine, once, twice and thrice. Those of
    dates and times of day are none."""
    words = "|".join([*(f"(?:{t})(?:[- ](?:{'|'.join(UNITS[1:10])}))?" for t in TENS), *sorted([*UNITS, *HOW_OFTEN], key=len, reverse=True)])
    rest = F.regexp_replace(F.lower(text), "|".join([*DATE_FORMS, *TIME_FORMS]), " ")
    found = F.regexp_extract_all(rest, F.lit(rf"(-?\b\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?\b|-?\b\d+(?:\.\d+)?\b|\b(?:{words})\b)"), F.lit(1))
    value = F.create_map(*[F.lit(x) for pair in [*((w, float(i)) for i, w in enumerate(UNITS)), *((k, float(v)) for k, v in TENS.items()), *HOW_OFTEN.items()] for x in pair])
    of_word = lambda x: F.aggregate(F.split(x, "[- ]"), F.lit(0.0), lambda acc, w: acc + F.coalesce(value[w], F.lit(0.0)))
    return F.transform(found, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, ",", "").cast("double")).otherwise(of_word(x)))


def clock_times(text: Column) -> Column:
    """All times of day in order, as minutes: those of minutes(), and 'half past six', 'quarter to 7 pm', '10 minutes past two'. Those out of
    range are left out; dates are none."""
    rest = F.regexp_replace(F.lower(text), "|".join(DATE_FORMS), " ")
    found = F.regexp_extract_all(rest, F.lit("(" + "|".join(TIME_FORMS) + ")"), F.lit(1))
    part = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    hours = F.create_map(*[F.lit(x) for i, w in enumerate(UNITS[1:13], 1) for x in (w, i)])

    def of_phrase(x: Column) -> Column:
        a, way, b, half = (F.regexp_extract(x, PHRASE, k) for k in (1, 2, 3, 4))
        m, h = F.coalesce(part[a], a.try_cast("int")), F.coalesce(hours[b], b.try_cast("int"))
        hour = F.when(half == "", h).when(half == "p", h % 12 + 12).otherwise(h % 12)
        fits = (m < 60) & F.when(half == "", h < 24).otherwise(h.between(1, 12))
        return F.when(fits, F.pmod(hour * 60 + F.when(way == "to", -m).otherwise(m), F.lit(1440)))

    return F.filter(F.transform(found, lambda x: F.when(x.rlike(r"\b(past|to)\b"), of_phrase(x)).otherwise(minutes(x))), lambda x: x.isNotNull())


def minutes(text: Column) -> Column:
    """The first clock time as minutes of the day: 14:05, 2:05 pm, 2 pm, noon, midnight; null without one or out of range."""
    lower = F.lower(text)
    at = lambda p, g: F.regexp_extract(lower, p, g)
    clock, bare = CLOCK, BARE
    hour = lambda h, half: F.when(half == "", h).when(half == "p", h % 12 + 12).otherwise(h % 12)
    h, m, half = at(clock, 1).try_cast("int"), at(clock, 2).try_cast("int"), at(clock, 3)
    bh, bhalf = at(bare, 1).try_cast("int"), at(bare, 2)
    fits = (m < 60) & F.when(half == "", h < 24).otherwise(h.between(1, 12))
    return F.when(h.isNotNull(), F.when(fits, hour(h, half) * 60 + m)).when(bh.isNotNull(), F.when(bh.between(1, 12), hour(bh, bhalf) * 60)).when(lower.rlike(r"\bnoon\b"), 720).when(lower.rlike(r"\bmidnight\b"), 0)


def date_of(text: Column) -> Column:
    """The first date: 2024-03-05, March 5, 2024 or 5 March 2024; null without one or where there is no such day."""
    names = "|".join(MONTHS)
    month = lambda x: F.array_position(F.array(*map(F.lit, MONTHS)), x)
    lower = F.lower(text)
    at = lambda p, g: F.regexp_extract(lower, p, g)
    made = lambda y, m, d: F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    iso, us, day = r"\b(\d{4})-(\d{2})-(\d{2})\b", rf"\b({names})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({names})\s+(\d{{4}})\b"
    return F.when(at(iso, 1) != "", made(at(iso, 1), at(iso, 2), at(iso, 3))).when(at(us, 1) != "", made(at(us, 3), month(at(us, 1)), at(us, 2))).when(at(day, 1) != "", made(at(day, 3), month(at(day, 2)), at(day, 1)))


def letter(text: Column, options: int = 4) -> Column:
    """The option letter an answer names: alone, in brackets, or after 'answer'; null if it names none or several."""
    last = "ABCDEFGHIJ"[options - 1]
    found = F.array_distinct(F.regexp_extract_all(F.upper(F.trim(text)), F.lit(rf"(?:^|[(\[]|ANSWER(?: IS)?:?\s+|\b(?:OR|AND)\s+)([A-{last}])(?=$|[)\].:,\s])"), F.lit(1)))
    return F.when(F.size(found) == 1, found[0])


def yes_no(text: Column) -> Column:
    """True, false, or null where neither or both kinds of words stand."""
    has = lambda words: F.lower(text).rlike(rf"\b({'|'.join(words)})\b")
    return F.when(has(YES) & ~has(NO), True).when(has(NO) & ~has(YES), False)


def answer_fields(text: Column) -> Column:
    """answer and confidence (0 to 100, null if it is none) of 'text CONF: n', in any case; without the field all is answer."""
    pattern = r"(?is)^(.*?)\s*\bconf(?:idence)?\s*[:=]\s*(-?\d+)\s*%?\s*$"
    conf = F.regexp_extract(text, pattern, 2).try_cast("int")
    answer = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)
    return F.struct(F.trim(answer).alias("answer"), F.when(conf.between(0, 100), conf).alias("confidence"))


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by the columns; a name without a column is an error."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def title_likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the titles' lower-case words; 1 for two empty ones."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))
    x, y = key(a), key(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(F.round(1 - F.levenshtein(x, y) / longest, 6))


def markdown_units(text: Column) -> Column:
    """The text's units in order: headings and list items are units of one line, other lines up to a blank one are a paragraph; fenced
    code is one unit. Array of (kind, body)."""
    marked = F.regexp_replace(text, r"(?m)^(#{1,6} .*|\s*[-*+] .*|\s*\d+\. .*)$", "\n\n$1\n\n")
    blocks = F.filter(F.transform(F.split(marked, r"\n[ \t]*\n"), lambda x: F.trim(F.regexp_replace(x, r"^\n+|\n+$", ""))), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(r"^#{1,6} "), "heading").when(x.rlike(r"^([-*+]|\d+\.) "), "item").when(x.startswith("```"), "code").otherwise("paragraph")
    return F.transform(blocks, lambda x: F.struct(kind(x).alias("kind"), x.alias("body")))


def heading_path(units: Column, upto: Column) -> Column:
    """The headings in force before the unit number `upto` (from 1): of each level the last, until a higher one stands after it."""
    level = lambda x: F.length(F.regexp_extract(x["body"], r"^(#{1,6}) ", 1))
    keep = lambda acc, x: F.concat(F.filter(acc, lambda h: level(h) < level(x)), F.array(x))
    heads = F.filter(F.slice(units, 1, F.greatest(upto - 1, F.lit(0))), lambda x: x["kind"] == "heading")
    start = F.array().cast("array<struct<kind:string,body:string>>")
    return F.transform(F.aggregate(heads, start, keep), lambda x: F.regexp_replace(x["body"], r"^#{1,6} +", ""))
