"""Scalar projections over text, ids and JSON: Columns in, Columns out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Where an id may stand, in order of preference.
ID_FIELDS = ("_id", "id", "text_id", "sample_id", "filename")


def doc_key(df: DataFrame, fields=ID_FIELDS) -> Column:
    """The first id field that isn't null, as a string; a row without any is an error."""
    there = [F.col(f).cast("string") for f in fields if f in df.columns]
    missing = F.raise_error(F.lit(f"a row has none of the id fields {', '.join(fields)}")).cast("string")
    return F.coalesce(*there, missing)


def markers(template: Column) -> Column:
    """Names in angle brackets, left to right."""
    return F.regexp_extract_all(template, F.lit("<([^>]*)>"), F.lit(1))


def fill_template(df: DataFrame, template: str, allow_missing: bool = False) -> Column:
    """The template with every ``<a.b>`` replaced by that column's value.

    Markers are replaced one after the other, so a value that holds a later marker is expanded too.
    """
    def exists(path: str) -> bool:
        try:
            df.select(path)
            return True
        except Exception as e:
            if "UNRESOLVED_COLUMN" in str(e) or "FIELD_NOT_FOUND" in str(e):
                return False
            raise

    out = F.lit(template)
    for name in dict.fromkeys(re.findall(r"<([^>]*)>", template)):
        if exists(name):
            value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        elif allow_missing:
            value = F.lit("")
        else:
            raise ValueError(f"the template asks for {name}, which isn't there")
        out = F.replace(out, F.lit(f"<{name}>"), value)
    return out


def with_instruction(instruction: Column, text: Column, sep: str = "") -> Column:
    """Instruction before text; a null part is empty. Text-only examples use ``sep=' '``."""
    return F.concat(F.coalesce(instruction, F.lit("")), F.lit(sep), F.coalesce(text, F.lit("")))


def or_empty(text: Column, image: Column, word: str = "document") -> Column:
    """A placeholder where neither an image nor a text is there."""
    return F.when(image.isNull() & (F.coalesce(text, F.lit("")) == ""), F.lit(f"empty {word}")).otherwise(text)


def image_of(df: DataFrame) -> Column:
    """``image_base64`` if there, else ``image``."""
    there = [F.col(c) for c in ("image_base64", "image") if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def to_base64(content: Column) -> Column:
    """Base64 on one line."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def url_doc_id(url: Column) -> Column:
    """The last three parts of a url as ``a_b__c``."""
    parts = F.split(url, "/")
    return F.concat(F.element_at(parts, -3), F.lit("_"), F.element_at(parts, -2), F.lit("__"), F.element_at(parts, -1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def collection_of(page_id: Column) -> Column:
    """All but the last ``_`` part."""
    return F.regexp_extract(page_id, r"^(.*)_([^_]*)$", 1)


def page_of(page_id: Column) -> Column:
    return F.substring_index(page_id, "_", -1).try_cast("int")


def without_suffix(value: Column, suffix: str) -> Column:
    """The suffix as a whole is taken off, not its characters."""
    return F.regexp_replace(value, re.escape(suffix) + "$", "")


def fenced_json(response: Column) -> Column:
    """What stands between the first JSON code fences; null without them."""
    return F.nullif(F.regexp_extract(response, r"(?s)```json\n(.*?)\n```", 1), F.lit(""))


def brace_json(response: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    start = F.instr(response, "{")
    end = F.length(response) - F.instr(F.reverse(response), "}") + 1
    return F.when((start > 0) & F.contains(response, F.lit("}")) & (end >= start), F.substr(response, start, end - start + 1))


#: What counts as white space between words, in Unicode as in ASCII.
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def wrap(text: Column, width: int) -> Column:
    """Greedy lines: a word joins the line while the two and a blank fit.

    A line that is still empty counts its blank too, so the first line holds one character less, and
    stays empty before a first word as long as the width. Longer words stand alone. Lines are found by
    regular expressions, in one walk over the text.
    """
    if width < 2:
        raise ValueError("lines of at least two characters")
    words = F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))
    first = F.regexp_extract(words, rf"(?s)^(.{{1,{width - 1}}})(?= |\z)", 1)
    rest = F.when(first == "", words).otherwise(F.substr(words, F.length(first) + 2))
    lines = F.regexp_extract_all(rest, F.lit(rf"(?s)(?:\S.{{0,{width - 1}}}|\S{{{width + 1},}})(?= |\z)"), F.lit(0))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(first), lines))


def leading_int(name: Column) -> Column:
    """The number that a name starts with, else infinity."""
    return F.coalesce(F.regexp_extract(name, r"^(\d+)", 1).try_cast("double"), F.lit(float("inf")))


def natural_key(name: Column) -> Column:
    """A key that sorts digit runs by value, whatever their length: a run is its digits without leading zeros, after how many there are."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda t: F.regexp_replace(t, r"^0+(?=\d)", "")
    # The count is three digits, or 999 and then ten.
    count = lambda t: F.when(F.length(digits(t)) < 999, F.lpad(F.length(digits(t)).cast("string"), 3, "0")).otherwise(F.concat(F.lit("999"), F.lpad(F.length(digits(t)).cast("string"), 10, "0")))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d"), F.concat(F.lit("0"), count(t), digits(t))).otherwise(t)), "")


def fill_prompt(prompt: str, passage: Column) -> Column:
    return F.replace(F.lit(prompt), F.lit("{passage}"), passage)


def any_case(json: Column, name: str) -> Column:
    """A JSON field whose name is in lower or upper case."""
    return F.coalesce(F.get_json_object(json, f"$.{name.lower()}"), F.get_json_object(json, f"$.{name.upper()}"))


def first_key_like(values: Column, part: str) -> Column:
    """The value of the map's first key that contains ``part``."""
    return F.get(F.map_values(F.map_filter(values, lambda k, _: F.contains(k, F.lit(part)))), F.lit(0))


def title_body(title: Column, body: Column, sep: str = "\t") -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(sep), F.coalesce(body, F.lit("")))


def metric_line(measure: Column, query: Column, value: Column) -> Column:
    """``measure`` in 25 columns, ``query`` in 8, the value with four decimals."""
    return F.format_string("%-25s%-8s%.4f", measure, query, value)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def any_glob(name: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.rlike(glob_regex(p)) for p in patterns], F.lit(False))
