"""Text functions, as expressions that stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- words and windows ----


# Unicode white space, as ``(?U)\s`` has it.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def words(text: Column | str) -> Column:
    """Fields between runs of Unicode white space."""
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def clamp_window(size: int, overlap: int) -> tuple[int, int]:
    """At least one word, and an overlap that leaves a step of one at least."""
    size = max(1, size)
    return size, min(max(0, overlap), size - 1)


def clamp_code_window(size: int, overlap: int) -> tuple[int, int]:
    """For code, an overlap out of range means none."""
    size = max(1, size)
    return size, overlap if 0 <= overlap < size else 0


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, ``overlap`` shared; a text that fits is left as it is, one without words gives none."""
    step = size - overlap

    def cut(own: Column) -> Column:
        last = F.ceil((F.size(own) - size) / F.lit(step)).cast("int") * step
        parts = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.array_join(F.slice(own, s + 1, size), " "))
        return F.when(F.size(own) == 0, F.array().cast("array<string>")).when(F.size(own) <= size, F.array(text)).otherwise(parts)

    return bound(words(text), cut)


def window_blocks(text: Column, size: int, overlap: int, per: int) -> Column:
    """Structs of the number of a first window and the words of ``per`` windows from there; a text that fits counts as one word."""
    step = size - overlap

    def cut(own: Column) -> Column:
        last = F.ceil((F.size(own) - size) / F.lit(step)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last, F.lit(per)), lambda k: F.struct(k.alias("first"), F.slice(own, k * step + 1, (per - 1) * step + size).alias("words")))
        return F.when(F.size(own) <= size, F.array(F.struct(F.lit(0).alias("first"), F.array(text).alias("words")))).otherwise(parts)

    return bound(words(text), cut)


def word_starts(own: Column, at_once: int = 8) -> Column:
    """Bytes before each of the words when a space parts them, and before one that would follow.

    Lengths are summed in groups of ``at_once``, then those of the groups, as each sum that is appended copies the ones before it.
    """

    def sums(values: Column, length: Callable[[Column], Column]) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda at, x: F.array_append(at, F.element_at(at, -1) + length(x)))

    def placed(groups: Column) -> Column:
        def moved(before: Column) -> Column:
            return F.flatten(F.transform(groups, lambda g, k: F.transform(F.slice(g, 2, at_once), lambda n: n + F.get(before, k))))

        return F.concat(F.array(F.lit(0)), bound(sums(groups, lambda g: F.element_at(g, -1)), moved))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(at_once))
    return bound(F.transform(firsts, lambda k: sums(F.slice(own, k, at_once), lambda w: F.octet_length(w) + 1)), placed)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body (or a lambda in it) names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(_SPACES))


# ---- matching ----


def contains_folded(text: Column | str, needle: str) -> Column:
    """Substring, whatever the case, by simple case folding of code points."""
    return _col(text).rlike("(?iu)" + java_quote(needle))


def java_quote(literal: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", literal)


def contains_lower(text: Column | str, needle: str) -> Column:
    return F.contains(F.lower(_col(text)), F.lit(needle.lower()))


def starts_with(path: Column | str, prefix: str) -> Column:
    return F.startswith(_col(path), F.lit(prefix))


def rewrite_prefix(path: Column | str, old: str, new: str) -> Column:
    path = _col(path)
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.char_length(path)))).otherwise(path)


def day(date: Column | str) -> Column:
    """The first ten characters of a date in ISO form."""
    return F.substring(_col(date), 1, 10)


# ---- excerpts ----


def snippet(text: Column | str, most: int) -> Column:
    """Struct of an excerpt of ``most`` characters at most and whether it was cut."""
    text = _col(text)
    fits = F.char_length(text) <= most
    cut = F.concat(F.rtrim(F.left(text, F.lit(most)), F.lit(" \n\t")), F.lit("…"))
    return F.struct(F.when(fits, text).otherwise(cut).alias("text"), (~fits).alias("truncated"))


def clamp(value: int, default: int, low: int, high: int) -> int:
    return min(max(value if value > 0 else default, low), high)


def match_context(text: Column, start: Column, length: Column, around: int = 120) -> Column:
    """What stands ``around`` a match (``start`` counts from 1), with an ellipsis at a cut end."""
    begin = F.greatest(start - around, F.lit(1))
    end = F.least(start + length + around, F.char_length(text) + 1)
    middle = trimmed(F.substring(text, begin, end - begin))
    return F.concat(F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), middle, F.when(end <= F.char_length(text), F.lit("…")).otherwise(F.lit("")))


def line_number(text: Column, start: Column) -> Column:
    """1 + line feeds before the place ``start`` (from 1)."""
    return F.size(F.split(F.substring(text, F.lit(1), start - 1), "\n"))


def highlight(text: Column | str, query: str) -> Column:
    """Marks the query's terms of over one character."""
    terms = [t for t in query.lower().split() if len(t) > 1]
    if not terms:
        return _col(text)
    return F.regexp_replace(_col(text), "(?iu)(" + "|".join(map(java_quote, terms)) + ")", "<mark>$1</mark>")


def days_since(moment: Column, now: Column) -> Column:
    """Whole days; null for a moment to come."""
    days = F.floor((now.cast("timestamp").cast("double") - moment.cast("timestamp").cast("double")) / 86400)
    return F.when(days >= 0, days)


# ---- folding of case ----


def _simple(letter: str) -> str:
    """Simple case folding: the folding if it is one letter, else lower case if that is."""
    return next((x for x in (letter.casefold(), letter.lower()) if len(x) == 1), letter)


def _orbit_table() -> tuple[str, str]:
    """Letters that fold alike are one orbit; each but its first letter, and that first one."""
    orbits: dict[str, list[str]] = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x1F000))):
        if unicodedata.category(c)[0] in "LNMS":
            orbits.setdefault(_simple(c), []).append(c)
    pairs = [(c, own[0]) for own in orbits.values() for c in own[1:]]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ORBIT_FROM, ORBIT_TO = _orbit_table()
_ORBITS = str.maketrans(ORBIT_FROM, ORBIT_TO)


def vfold(text: Column | str) -> Column:
    """A key for comparing without case: each letter becomes the first of those that differ by case alone (k, K and the Kelvin sign: K)."""
    text = _col(text)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, ORBIT_FROM, ORBIT_TO)).otherwise(F.upper(text))


def vfold_of(text: str) -> str:
    """The same for a text at hand."""
    return text.translate(_ORBITS)


# ---- full-text tokens ----

# Combining marks that belong to the letter before them and are dropped; other marks part tokens.
_DROPPED = [0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331]


def _folded(letter: str) -> str:
    """Simple case folding; a Latin letter with one mark becomes the letter alone."""
    low = next((x for x in (letter.casefold(), letter.lower()) if len(x) == 1), letter.lower()[:1])
    parts = unicodedata.normalize("NFD", low)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]) else low


def _fold_table() -> tuple[str, str]:
    """Letters that fold to others, and those; the marks that are dropped come last and have no other side."""
    pairs = [(c, _folded(c)) for c in map(chr, (*range(0xD800), *range(0xE000, 0x1F000))) if unicodedata.category(c)[0] in "LN"]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs) + "".join(map(chr, _DROPPED)), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()
_FOLDED = {ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO, strict=False)} | dict.fromkeys(_DROPPED)


def tokens(text: Column | str) -> Column:
    """Runs of letters, digits, and characters of private use or yet unknown, folded (see ``_folded``)."""
    text = _col(text)
    folded = F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, FOLD_FROM, FOLD_TO)).otherwise(F.lower(text))
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}\p{Cn}]+"), lambda t: t != "")


def tokens_of(text: str) -> list[str]:
    """The same for a text at hand: a query parts at the characters at which texts do."""
    folded = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Co", "Cn") else " " for c in text.translate(_FOLDED))
    return folded.split()


def query_phrases(query: str) -> list[list[str]]:
    """White space parts phrases; a phrase is the tokens of its field; fields without tokens are ignored."""
    return [found for field in query.split() if (found := tokens_of(field))]


def escape_query(query: str) -> str:
    """Each field in double quotes, inner quotes doubled."""
    return " ".join('"' + f.replace('"', '""') + '"' for f in query.split())


# ---- lists found in code ----

# Words that a table's name follows, alone or after another word, and words between.
_LEADS = ("from", "join", "into")
_PAIRS = (("create", "table"), ("alter", "table"))
_BETWEEN = (("if", "not", "exists"), ("if", "exists"), ())
_NAME_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_0123456789"


def is_name(word: Column) -> Column:
    """Letters, digits and underscores, no digit first."""
    first = F.left(word, F.lit(1))
    return (word != "") & (F.translate(word, _NAME_CHARACTERS, "") == "") & (F.translate(first, "0123456789", "") != "")


def _word_facts(word: Column) -> Column:
    """What a word is as a whole, what its last characters are, and the dotted name that it begins with (empty where none)."""
    others, beyond_dots = F.translate(word, _NAME_CHARACTERS, ""), F.translate(word, _NAME_CHARACTERS + ".", "")
    tail = F.when(others == "", word).otherwise(F.call_function("substring_index", word, F.right(others, F.lit(1)), F.lit(-1)))
    head = F.when(beyond_dots == "", word).otherwise(F.call_function("substring_index", word, F.left(beyond_dots, F.lit(1)), F.lit(1)))
    parts = F.split(head, "[.]")
    wrong = F.array_position(F.transform(parts, is_name), F.lit(False)).cast("int")
    name = F.array_join(F.when(wrong == 0, parts).otherwise(F.slice(parts, 1, wrong - 1)), ".")
    return F.struct(F.lower(word).alias("low"), F.lower(tail).alias("tail"), (F.char_length(word) - F.char_length(tail)).alias("before"), name.alias("name"))


def _named_table(facts: Column, i: Column) -> Column:
    """Where the phrase begins that ends with word ``i``, where the name stands after it, and the name; null where there is no such phrase."""

    def at(k: Column) -> Column:
        return F.get(facts, k)

    start = F.when(at(i)["tail"].isin(*_LEADS), i)
    for first, second in _PAIRS:
        start = start.when((at(i)["low"] == second) & (i > 0) & (at(i - 1)["tail"] == first), i - 1)
    place = None
    for between in _BETWEEN:
        after = i + 1 + len(between)
        holds = at(after)["name"] != ""
        for k, word in enumerate(between):
            holds &= at(i + 1 + k)["low"] == word
        place = F.when(holds, after) if place is None else place.when(holds, after)
    found = F.struct(start.alias("start"), at(start)["before"].alias("before"), place.alias("place"), at(place)["name"].alias("name"))
    return F.when(start.isNotNull() & place.isNotNull(), found)


def sql_tables(text: Column | str, most: int = 50) -> Column:
    """Distinct names that statements give to tables, in the order of the text; a name may have parts joined by dots.

    The words are walked once: a phrase counts only if it begins after the name found before it.
    """

    def walk(facts: Column) -> Column:
        spots = F.transform(F.sequence(F.lit(0), F.size(facts) - 1), lambda i: _named_table(facts, i))
        begin = F.struct(F.array().cast("array<string>").alias("names"), F.lit(-1).alias("place"), F.lit(0).alias("end"))

        def step(state: Column, x: Column) -> Column:
            after = (x["start"] > state["place"]) | ((x["start"] == state["place"]) & (x["before"] >= state["end"]))
            more = F.struct(F.array_append(state["names"], x["name"]).alias("names"), x["place"].alias("place"), F.char_length(x["name"]).alias("end"))
            return F.when(after, more).otherwise(state)

        return F.aggregate(F.filter(spots, lambda x: x.isNotNull()), begin, step, lambda state: state["names"])

    facts = F.transform(F.split(_col(text), r"\s+"), _word_facts)
    return F.slice(F.array_distinct(bound(facts, walk)), 1, most)


def shell_functions(text: Column | str) -> Column:
    """Distinct names of functions defined at the start of a line: a name and empty brackets, the word ``function`` before it or not."""
    # Lines end at line feeds alone.
    definition = r"(?md)^(?:function[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)[ \t]*\([ \t]*\)"
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(definition), F.lit(1)))
