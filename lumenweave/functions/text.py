"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts: separators, and the control characters that count as such.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
_EDGE_SPACE = rf"^{_SPACE}|{_SPACE}$"


def strip(c: Column) -> Column:
    """Without white space at either end; ``trim`` would keep tabs and line breaks."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def capitalize(c: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def upper_first(c: Column) -> Column:
    """First letter upper case, the rest as it is; an empty text stays empty."""
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def punctuate(c: Column) -> Column:
    """With a full stop unless it ends in ``. ? !``."""
    return F.when(c.rlike(r"[.?!]$"), c).otherwise(F.concat(c, F.lit(".")))


def format_text(c: Column, *, strip_text: bool = True, capitalized: bool = True, punctuated: bool = True, bos: str | None = None, eos: str | None = None) -> Column:
    """Strip, capitalize, punctuate, then add ``bos`` and ``eos`` where they are missing; null stays null."""
    c = strip(c) if strip_text else c
    c = capitalize(c) if capitalized else c
    c = punctuate(c) if punctuated else c
    if bos is not None:
        c = F.when(F.startswith(c, F.lit(bos)), c).otherwise(F.concat(F.lit(bos), c))
    if eos is not None:
        c = F.when(F.endswith(c, F.lit(eos)), c).otherwise(F.concat(c, F.lit(eos)))
    return c


#: The words that are left out. Fixed values.
ARTICLES = ("a", "an", "the", "some")


def remove_articles(c: Column) -> Column:
    """Without the words a, an, the and some; white space runs become one space."""
    bare = F.regexp_replace(c, rf"(?iU)\b({'|'.join(ARTICLES)})\b", "")
    return strip(F.regexp_replace(bare, _SPACE, " "))


def span_phrase(c: Column, start: Column, end: Column) -> Column:
    """The lower-case text from character ``start`` up to ``end``, counted from 0."""
    return F.lower(c.substr(start.cast("int") + 1, (end - start).cast("int")))


def contains_any(c: Column, patterns: list[str]) -> Column:
    """Whether the lower-case text contains one of the patterns."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.contains(F.lower(c), F.lit(p))
    return found


def without_image_mark(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n<image>"), F.lit("")), F.lit("<image>\n"), F.lit(""))


def fill_placeholders(caption: Column, texts: Column) -> Column:
    """``<coords_i>`` replaced by element i of the array of texts."""
    indexes = F.sequence(F.lit(0), F.size(texts) - 1)
    filled = F.aggregate(indexes, caption, lambda acc, i: F.replace(acc, F.concat(F.lit("<coords_"), i.cast("string"), F.lit(">")), F.coalesce(F.get(texts, i), F.lit(""))))
    return F.when(F.size(texts) > 0, filled).otherwise(caption)


def ocr_context(tokens: Column) -> Column:
    """``OCR text:`` and the ``key: value`` lines of an array of (key, value) structs in key order; empty without tokens."""
    lines = F.array_join(F.transform(F.array_sort(tokens), lambda t: F.concat(t["key"], F.lit(": "), t["value"])), "\n")
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit("OCR text:\n"), lines))


def letter_choices(choices: Column) -> Column:
    """``A: first`` and so on, one line each, for at most 26 choices, then ``Answer: ``."""
    lettered = F.transform(F.slice(choices, 1, 26), lambda x, i: F.concat(F.char(i + 65), F.lit(": "), x, F.lit("\n")))
    return F.concat(F.array_join(lettered, ""), F.lit("Answer: "))


def answer_letter(choices: Column, answer: Column) -> Column:
    """The letter of the first choice that equals the answer; null if none does."""
    at = F.array_position(choices, answer)
    return F.when(at > 0, F.char(at.cast("int") + 64))


def format_bbox(box: Column, *, punctuated: bool = True) -> Column:
    """``[x.xx,...]`` with two digits, rounded half to even as the exact binary value demands."""
    numbers = F.transform(box, lambda v: F.replace(F.format_number(v.cast("double"), 2), F.lit(","), F.lit("")))
    return F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]." if punctuated else "]"))


def parse_bbox(c: Column) -> Column:
    """The four numbers between ``[`` and ``]``; null unless there are four."""
    parts = F.split(F.regexp_extract(c, r"\[([^\]]*)\]", 1), ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(numbers) == 4) & F.forall(numbers, lambda v: v.isNotNull()), numbers)


def truncate_output(c: Column, *, eos: str = "<|endoftext|>", lowered: bool = True) -> Column:
    """A model's output up to the first full stop before the end mark, or up to the mark."""
    cut = F.substring_index(F.substring_index(c, "." + eos, 1), eos, 1)
    return F.lower(cut) if lowered else cut


def first_segment(c: Column, *, eos: str = "<|endoftext|>") -> Column:
    """Without the end mark, up to the first full stop."""
    return F.substring_index(F.replace(c, F.lit(eos), F.lit("")), ".", 1)


def parse_bins(c: Column) -> Column:
    """The numbers of ``<bin_12><bin_3>...`` as doubles, without sequence marks, padding and full stops."""
    bare = F.regexp_replace(c, r"<s>|</s>|<pad>|\.", "")
    numbers = F.split(F.regexp_replace(F.regexp_replace(bare, r"^<bin_|>$", ""), r"><bin_", ","), ",")
    return F.transform(numbers, lambda p: F.trim(p).try_cast("double"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def numbered_image(number: Column, digits: int = 12) -> Column:
    """The number padded with zeros, with ``.jpg``."""
    return F.concat(F.lpad(number.cast("string"), digits, "0"), F.lit(".jpg"))


def unbroken(c: Column) -> Column:
    """Line breaks that a model writes out as text, and real ones, removed."""
    return strip(F.replace(F.replace(c, F.lit("\\n"), F.lit("")), F.lit("\n"), F.lit("")))
