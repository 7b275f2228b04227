"""The JSON text of ``metadata`` and the keys that follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory name -> collection of the picture key. Fixed values.
COLLECTIONS = {
    "coco": "coco",
    "visual_genome": "vg",
    "ocr_vqa": "ocrvqa",
    "docvqa": "docvqa",
    "text_vqa": "textvqa",
    "textvqa": "textvqa",
    "grit": "grit",
}


def _in_list(json_text: Column) -> Column:
    """The text as the only element of a list: what follows a first value then spoils the list."""
    return F.concat(F.lit("["), json_text, F.lit("]"))


def variant(json_text: Column) -> Column:
    """The JSON text as a variant; null where it does not parse.

    Text after the first JSON value counts as a failure, as does a key that occurs twice.
    """
    whole = F.try_parse_json(_in_list(json_text))
    return F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "variant"))


def fields(json_text: Column, *names: str) -> Column:
    """A struct of the named top-level fields as text; all null where the text does not parse or is no object.

    One pass over the text reads all fields; ``parsed`` tells whether it parses.
    """
    schema = "array<struct<" + ",".join(f"`{n}`:string" for n in names) + ">>"
    j = F.from_json(_in_list(json_text), schema)
    ok = F.coalesce((F.size(j) == 1) & F.get(j, F.lit(0)).isNotNull(), F.lit(False))
    return F.struct(*[F.when(ok, F.get(j, F.lit(0))[n]).alias(n) for n in names], ok.alias("parsed"))


def last_number(path: Column) -> Column:
    """The last run of digits of the file name before its extension; null without digits."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1)
    return F.when(digits != "", digits)


def _padded(digits: Column) -> Column:
    plain = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.when(F.length(plain) >= 12, plain).otherwise(F.lpad(plain, 12, "0"))


def collection(path: Column) -> Column:
    """The collection of the last directory that names one; null where none does."""
    directory = F.regexp_extract(F.lower(path), r"^(.*)[/\\]", 1)
    found = F.regexp_extract(directory, r"^(?:.*[/\\])?(" + "|".join(COLLECTIONS) + r")(?:[/\\].*)?$", 1)
    out = F.lit(None).cast("string")
    for name, key in COLLECTIONS.items():
        out = F.when(found == name, F.lit(key)).otherwise(out)
    return out


def picture_key(path: Column, coco_id: Column) -> Column:
    """``collection/number`` of a picture, the number padded to 12 digits.

    ``coco_id`` goes first if it is a number; a path without a known directory or
    without digits gives null.
    """
    coco = F.regexp_extract(F.trim(coco_id), r"^([0-9]+)(?:\.0+)?$", 1)
    by_path = F.concat(collection(path), F.lit("/"), _padded(last_number(path)))
    return F.when(coco != "", F.concat(F.lit("coco/"), _padded(coco))).otherwise(by_path)
