"""String, date and name functions on columns; all but `word_changes` are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def normalize_quotes(text: Column) -> Column:
    """Curly quotes to straight ones."""
    return F.translate(text, "‘’“”", "''\"\"")


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_date(text: Column) -> Column:
    """year-month-day, unpadded parts too; null if it isn't three parts or no date of the calendar."""
    return F.when(F.size(F.split(text, "-")) == 3, F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"))


def _lookup(name: Column, names: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for alias, value in names.items():
        out = F.when(name == alias, value).otherwise(out)
    return out


def element_type(tag: Column) -> Column:
    """Type of a tag in any case; `unknown` for others."""
    low = F.lower(tag)
    return F.when(low.isin(*schema.ELEMENT_TYPES), low).otherwise(_lookup(low, schema.DOCUMENT_ALIASES, F.lit("unknown")))


def amending_action(name: Column) -> Column:
    """Null for unknown actions."""
    low = F.lower(name)
    return F.when(low.isin(*schema.ACTIONS), low).otherwise(_lookup(low, schema.ACTION_ALIASES, F.lit(None).cast("string")))


def party(name: Column) -> Column:
    """Parties by their aliases; other names stay as they are."""
    return _lookup(name, schema.PARTIES, name)


def chamber(name: Column) -> Column:
    """House or Senate by their aliases; null for other names."""
    return _lookup(name, schema.CHAMBERS, F.lit(None).cast("string"))


def structural_path(parent: Column, kind: Column, number: Column) -> Column:
    """parent/<type>_<number>; without a parent the root alone."""
    own = F.when(kind == "uscodedocument", F.lit("uscode")).otherwise(F.concat(kind, F.lit("_"), F.coalesce(number, F.lit(""))))
    return F.concat_ws("/", parent, own)


def verbose_name(parent: Column, display: Column) -> Column:
    return F.concat_ws(" ", parent, display)


def short_path(path: Column) -> Column:
    """The last six segments."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 6, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -6, 6), "/"))).otherwise(path)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def annotator_kind(annotator: Column) -> Column:
    """human or model from the prefix of a name, else unknown."""
    return F.when(annotator.startswith("human:"), "human").when(annotator.startswith("model:") | annotator.startswith("ai:"), "model").otherwise("unknown")


def is_significant(word: Column) -> Column:
    return (word != "") & ~F.lower(word).isin(*schema.STOP_WORDS)


def amendment_id(bill_id: Column, text: Column) -> Column:
    return F.sha2(F.concat(bill_id, F.lit(":"), text), 256)


def section_number(path: Column) -> Column:
    """Number of the first segment named section; null if there is none."""
    own = F.filter(F.split(path, "/"), lambda s: s.startswith("section_"))
    return F.substring(F.get(own, F.lit(0)), 9, 1 << 20)


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def section_pattern(path: Column) -> Column:
    return F.concat(F.lit(r"(?U)[Ss]ection\s*"), _quoted(section_number(path)), F.lit(r"\D"))


def mention_pattern(path: Column) -> Column:
    """The section, then each deeper number in parentheses."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, lambda s: s.startswith("section_")), True)
    deeper = F.filter(F.slice(parts, (at + 1).cast("int"), F.size(parts)), lambda s: F.contains(s, F.lit("_")))
    numbers = F.transform(deeper, lambda s: F.concat(F.lit(r"\("), _quoted(F.regexp_extract(s, r"^[^_]*_(.*)$", 1)), F.lit(r"\)\s*")))
    return F.when(at > 0, F.concat(F.lit(r"(?U)[Ss]ection\s*"), _quoted(section_number(path)), F.array_join(numbers, "")))
