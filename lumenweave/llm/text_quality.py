"""Per-document text statistics, and prose told from lists, tables and junk.

All counts are vectorized over the lines and words of an Arrow batch. Published
fixed thresholds are applied to a document's statistics, and every rule that it
fails is recorded as a reason. A document that fails none is prose. For one that
fails, the same counts are taken of each line; fixed thresholds on bullets,
separators, symbols, repetition and common words name a line's kind and the rule
that did so, and the kind that holds more than half of the characters is the
document's. Repetition may have any period: words are compared, and characters on
lines with hardly any spaces.

Defined cases: null, empty and blank texts have zero counts, no failures, no
kind; very long texts are measured whole; repeated rows stay; extra columns are
ignored; empty tables give no rows; without common words their share is 0.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.llm.bpe import spread

#: Characters measured at once; a bound on memory only.
CHUNK_CHARS = 4_000_000
#: Published limits for prose: at least, at most.
LIMITS = {
    "word_count": (50, 100_000),
    "mean_word_length": (3.0, 10.0),
    "symbol_ratio": (0.0, 0.1),
    "bullet_lines": (0.0, 0.9),
    "ellipsis_lines": (0.0, 0.3),
    "alphabetic_words": (0.8, 1.0),
    "common_words": (2, float("inf")),
    "punctuated_lines": (0.12, 1.0),
    "short_lines": (0.0, 0.67),
    "repeated_lines": (0.0, 0.3),
    "repeated_passages": (0.0, 0.1),
    "common_word_share": (0.3, 1.0),
    "special_characters": (0.0, 0.4),
}
#: Words of the passages whose repetition is limited. Published with the limit.
PASSAGE = 10
KINDS = ("list", "table", "junk")
_LETTERS = r"[\p{L}\p{M}]"
_PLAIN = """.,;:!?"'()-–—…«»“”„‘’¿¡。、，！？：；（）「」『』・/%&"""
#: Kinds of characters, one bit each: letters and marks, digits, spaces, box drawing and broken ones, usual punctuation, all that are special, ASCII letters.
KINDS_OF_CHARACTERS = ("letters", "digits", "spaces", "blocks", "plain", "special", "ascii_letters")
_ENDS = r"""[.!?。！？…]["'”’»)\]]*\s*$"""
_BOUNDARY = r"""[.!?。！？]["'”’»)]*[\s　]+\S|。\S"""
_BULLET = r"^\s*([-*•+–—▪◦‣·]\s+\S|\(?[0-9]{1,4}[.)]\s+\S|\(?[a-zA-Z][.)]\s+\S|[0-9]{1,4}x\s+\S|#[0-9]+\s+\S|\[[ xX]?\]\s+\S)"
_TAGGED_ROW = r"^\s*<[^<>]+>\s{2,}\["
_BORDER = r"^\s*[+|][-+=|: ]{3,}$"
_WORD_EDGE = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "«»“”„‘’¿¡…—–。、"
#: Periods that are tried one by one; longer ones are found by their repeated windows.
_MOST_PERIOD = 64
#: A line has hardly any spaces if its words have so many characters on average.
_UNSPACED = 20

_STATS = [
    ("n_chars", "long"), ("word_count", "long"), ("line_count", "long"), ("mean_word_length", "double"), ("symbol_ratio", "double"),
    ("punctuated_line_share", "double"), ("bullet_line_share", "double"), ("ellipsis_line_share", "double"), ("short_line_share", "double"),
    ("repeated_line_share", "double"), ("repeated_passage_share", "double"), ("alphabetic_word_share", "double"), ("common_word_count", "long"), ("common_word_share", "double"), ("special_character_share", "double"),
    ("list_share", "double"), ("table_share", "double"), ("junk_share", "double"), ("kind", "string"), ("kind_rule", "string"), ("failures", "array<string>"),
]


def _kinds_of(code: int) -> int:
    c = chr(code)
    category = unicodedata.category(c)
    white = c in " \t\n\r\f\v"
    bits = (
        category[0] in "LM", category[0] == "N", white or category[0] == "Z", 0x2500 <= code <= 0x25FF or code == 0xFFFD or 0x80 <= code <= 0x9F,
        c in _PLAIN, category[0] in "PSN" or white, c.isascii() and c.isalpha(),
    )
    return sum(1 << i for i, bit in enumerate(bits) if bit)


@cache
def _character_table() -> np.ndarray:
    """The kinds of all characters of the basic plane; the others are looked up as they come."""
    return np.array([0 if 0xD800 <= code < 0xE000 else _kinds_of(code) for code in range(0x10000)], np.uint8)


def count_characters(lines: pa.Array, n: np.ndarray) -> dict[str, np.ndarray]:
    """How many characters of each kind each line has; ``n``: its length, above 0."""
    codes = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32)
    kinds = _character_table()[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        values, which = np.unique(codes[far], return_inverse=True)
        kinds[far] = np.array([_kinds_of(int(v)) for v in values], np.uint8)[which]
    starts = np.cumsum(n) - n
    count = lambda bit: np.add.reduceat((kinds >> bit & 1).astype(np.int64), starts) if len(n) else np.zeros(0, np.int64)
    return {name: count(bit) for bit, name in enumerate(KINDS_OF_CHARACTERS)}


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _has(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), np.repeat(np.arange(len(lists)), lengths)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a), float), where=b > 0)


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each place's run of set flags with one owner, -1 outside; and the runs' lengths."""
    n = len(flags)
    starts = flags & np.concatenate([[True], ~flags[:-1] | (owner[1:] != owner[:-1])])[:n]
    number = np.where(flags, np.cumsum(starts) - 1, -1)
    return number, np.bincount(number[flags], minlength=int(starts.sum()))


def _window_keys(codes: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of the length and its document."""
    value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    power = np.multiply.accumulate(np.full(len(codes), 0xD6E8FEB86659FD93, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((value ^ (value >> np.uint64(32))) * power)])
    n = len(codes) - length + 1
    return (sums[length:] - sums[:-length]) * power[::-1][:n] + (doc[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)


def _mark_long_periods(codes: np.ndarray, doc: np.ndarray, marked: np.ndarray) -> None:
    """Marks stretches that repeat at least four times with a period above ``_MOST_PERIOD``.

    In a stretch of period p, a window of p or more occurs last exactly p before. Windows of
    doubling lengths thus show all periods from half their length to their length.
    """
    sizes, length = np.bincount(doc), 2 * _MOST_PERIOD
    while sizes.max(initial=0) >= 4 * (length // 2 + 1):
        place = np.flatnonzero(sizes[doc] >= 4 * (length // 2 + 1))
        c, owner = codes[place], doc[place]
        starts = np.flatnonzero(owner[length - 1 :] == owner[: len(owner) - length + 1])
        key = _window_keys(c, owner, length)[starts]
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        back = np.zeros(len(c), np.int64)
        back[starts[order[again + 1]]] = starts[order[again + 1]] - starts[order[again]]
        number, lengths = _runs((back > length // 2) & (back <= length), back)
        _, first = np.unique(number[number >= 0], return_index=True)
        first = np.flatnonzero(number >= 0)[first]
        for at, matching in zip(first, lengths + length - 1, strict=True):
            period = back[at]
            if matching >= 3 * period and np.array_equal(c[at : at + matching], c[at - period : at - period + matching]):
                marked[place[at - period : at + matching]] = True
        length *= 2


def _repeated_words(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words, or characters, within a stretch that repeats with some period at least four times."""
    marked = np.zeros(len(codes), bool)
    own = doc.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    for period in range(1, min(_MOST_PERIOD, len(codes) - 1) + 1):
        at = np.flatnonzero(own[period:] == own[:-period])
        least = max(3 * period, 8)
        if len(at) < least:
            continue
        # Runs of places one after the other; none crosses from one document to the next.
        first = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
        lengths = np.diff(np.append(first, len(at)))
        for k in np.flatnonzero(lengths >= least):
            marked[at[first[k]] : at[first[k]] + lengths[k] + period] = True
    _mark_long_periods(codes, doc, marked)
    return marked


def _in_passages(codes: np.ndarray, doc: np.ndarray, length: int = PASSAGE) -> np.ndarray:
    """Words within a passage of the length that occurs again in its document."""
    marked = np.zeros(len(codes), bool)
    if len(codes) < length:
        return marked
    starts = np.flatnonzero(doc[length - 1 :] == doc[: len(doc) - length + 1])
    _, number, times = np.unique(_window_keys(codes, doc, length)[starts], return_inverse=True, return_counts=True)
    change = np.zeros(len(codes) + 1, np.int64)
    again = starts[times[number] > 1]
    np.add.at(change, again, 1)
    np.add.at(change, again + length, -1)
    return np.cumsum(change[:-1]) > 0


def _repeated_characters(lines: pa.Array, doc: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """How many characters of each chosen line lie within a stretch that repeats; 0 for the others."""
    line = np.flatnonzero(chosen)
    texts = lines.take(pa.array(line)).to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    line = np.repeat(line, [len(t) for t in texts])
    return np.bincount(line, weights=_repeated_words(codes, doc[line]), minlength=len(chosen))


class Measure:
    def __init__(self, common: list[str]) -> None:
        self.common = pa.array(sorted(set(common)), pa.string())

    def _words(self, lines: pa.Array, line_doc: np.ndarray) -> dict[str, np.ndarray]:
        words, line = _flat(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(lines)))
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        words, line = words.filter(pa.array(filled)), line[filled]
        bare = pc.utf8_trim(pc.utf8_lower(words), characters=_WORD_EDGE)
        bare = pc.if_else(pc.equal(bare, ""), words, bare)  # a word of symbols only stands for itself
        codes = pc.dictionary_encode(bare).indices.to_numpy(zero_copy_only=False)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        return {
            "line": line, "size": size, "alphabetic": _has(words, _LETTERS),
            "common": pc.is_in(bare, value_set=self.common).to_numpy(zero_copy_only=False), "repeated": _repeated_words(codes, line_doc[line]),
            "passages": _in_passages(codes, line_doc[line]),
        }

    def _line_kinds(self, lines: pa.Array, doc: np.ndarray, n: np.ndarray, words: dict[str, np.ndarray], characters: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The kind of each line (-1 is prose) and the rule that named it."""
        count = len(n)
        per_line = lambda weights=None: np.bincount(words["line"], weights=weights, minlength=count)
        n_words, common = per_line(), per_line(words["common"])
        repeated, word_chars = per_line(words["repeated"] * words["size"]), per_line(words["size"])
        unspaced = (n_words > 0) & (word_chars >= _UNSPACED * n_words)
        if unspaced.any():
            repeated = np.maximum(repeated, _repeated_characters(lines, doc, unspaced))
        letters, digits, spaces, blocks, plain = (characters[k] for k in ("letters", "digits", "spaces", "blocks", "plain"))
        other = np.maximum(n - letters - digits - spaces - plain, 0)
        marks = n - letters - digits - spaces
        pipes, tabs, gaps = _count(lines, r"\|"), _count(lines, "\t"), _count(pc.utf8_rtrim_whitespace(lines), r"\S {2,}")
        tight = np.maximum(_count(lines, r",[^\s,]"), _count(lines, r";[^\s;]"))
        bullet, ended, inside = _has(lines, _BULLET), _has(lines, _ENDS), _has(lines, _BOUNDARY)
        longest = np.zeros(count, np.int64)
        np.maximum.at(longest, words["line"], words["size"])
        ascii_run = _has(lines, r"[A-Za-z0-9+/=_\-]{40,}")
        hexes = _count(lines, r"\b[0-9a-fA-F]{2}\b")
        common_share = _share(common, n_words)
        garbled = (marks > 0.08 * n) & (common_share < 0.12) & (other >= 1) & (characters["ascii_letters"] > 0.5 * letters)
        kind, rule = np.full(count, -1), np.full(count, "", dtype=object)

        def name(where: np.ndarray, what: str, why: str) -> None:
            free = where & (kind < 0) & (n > 0)
            kind[free], rule[free] = KINDS.index(what), why

        name(blocks > 0.03 * n, "junk", "block characters")
        name((hexes >= 8) & (3 * hexes > 0.8 * n), "junk", "hexadecimal")
        name(ascii_run & (longest > 0.5 * n), "junk", "encoded")
        name(_has(lines, _BORDER), "table", "border")
        name(_has(lines, _TAGGED_ROW), "table", "tagged row")
        name((tabs >= 2) & (other <= 0.1 * n), "table", "tabs")
        name((pipes >= 2) & (other - pipes <= 0.05 * n), "table", "bars")
        name((tight >= 3) & (tight * 3 >= n_words) & (other <= 0.05 * n) & ~inside, "table", "delimiters")
        name((gaps >= 2) & (gaps + 1 >= 0.75 * n_words) & (other <= 0.1 * n), "table", "columns")
        name((_count(lines, r"</?[a-zA-Z][^<>]*>") >= 2) & (other > 0.1 * n), "junk", "markup")
        name((other > 0.15 * n) | (marks > 0.5 * n), "junk", "symbols")
        name(garbled, "junk", "garbled")
        name((repeated > 0.6 * word_chars) & (word_chars > 0), "junk", "repetition")
        name(bullet, "list", "bullets")
        # Many short items on one line, between one kind of separator.
        for pattern, why in ((r",\s", "commas"), (r";\s", "semicolons"), (r"\s/\s", "slashes"), (r"(^|\s)#\S", "hashes"), (r"\s[|•·]\s", "bars"), (r"\s[-–—]\s", "dashes")):
            items = _count(lines, pattern) + 1
            name((items >= 4) & (n_words <= 3.2 * items) & ~inside & ~ended, "list", why)
        # Several short lines without sentences, unless they are one text wrapped at a width.
        fragment = (kind < 0) & (n > 0) & ~ended & ~inside & (n_words <= 16)
        number, lengths = _runs(fragment, doc)
        if len(lengths):
            widest = np.zeros(len(lengths), np.int64)
            member = number >= 0
            np.maximum.at(widest, number[member], n[member])
            near = np.bincount(number[member], weights=n[member] >= widest[number[member]] - 16, minlength=len(lengths))
            wrapped = (widest >= 55) & (near >= 0.7 * (lengths - 1))
            name(member & ~wrapped[number] & (lengths[number] >= 3), "list", "short lines")
        return kind, rule

    def __call__(self, texts: pa.Array) -> dict[str, list]:
        count = len(texts)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lines, doc = _flat(pc.split_pattern_regex(texts, r"\r\n|\r|\n"))
        visible = _has(lines, r"[^\s\p{Z}\p{C}]")
        lines, doc = lines.filter(pa.array(visible)), doc[visible]
        n = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        words = self._words(lines, doc)
        characters = count_characters(lines, n)
        kind, rule = self._line_kinds(lines, doc, n, words, characters)
        by_line = lambda weights=None: np.bincount(doc, weights=weights, minlength=count)
        word_doc = doc[words["line"]]
        by_word = lambda weights=None: np.bincount(word_doc, weights=weights, minlength=count)
        n_lines, n_words = by_line(), by_word()
        symbols = _count(lines, r"#|…|\.\.\.")
        trimmed = pc.utf8_trim_whitespace(lines)
        line_codes = pc.dictionary_encode(trimmed).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first = np.unique(doc * (line_codes.max(initial=0) + 1) + line_codes, return_index=True)
        again = np.ones(len(doc), bool)
        again[first] = False
        s = {
            "n_chars": pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64),
            "word_count": n_words, "line_count": n_lines,
            "mean_word_length": _share(by_word(words["size"]), n_words), "symbol_ratio": _share(by_line(symbols), n_words),
            "punctuated_line_share": _share(by_line(_has(lines, _ENDS)), n_lines), "bullet_line_share": _share(by_line(_has(lines, _BULLET)), n_lines),
            "ellipsis_line_share": _share(by_line(_has(lines, r"(…|\.\.\.)\s*$")), n_lines), "short_line_share": _share(by_line(n < 30), n_lines),
            "repeated_line_share": _share(by_line(again), n_lines), "repeated_passage_share": _share(by_word(words["size"] * words["passages"]), by_word(words["size"])), "alphabetic_word_share": _share(by_word(words["alphabetic"]), n_words),
            "common_word_count": by_word(words["common"]).astype(np.int64), "common_word_share": _share(by_word(words["common"]), n_words),
            "special_character_share": _share(by_line(characters["special"]), by_line(n)),
        }
        chars = by_line(n)
        shares = np.stack([_share(by_line(n * (kind == k)), chars) for k in range(len(KINDS))])
        measured = {"word_count": n_words, "common_words": s["common_word_count"]} | {k: s[c] for k, c in (("mean_word_length", "mean_word_length"), ("symbol_ratio", "symbol_ratio"), ("bullet_lines", "bullet_line_share"), ("ellipsis_lines", "ellipsis_line_share"), ("alphabetic_words", "alphabetic_word_share"), ("punctuated_lines", "punctuated_line_share"), ("short_lines", "short_line_share"), ("repeated_lines", "repeated_line_share"), ("repeated_passages", "repeated_passage_share"), ("common_word_share", "common_word_share"), ("special_characters", "special_character_share"))}
        failing = {k: (v < LIMITS[k][0]) | (v > LIMITS[k][1]) for k, v in measured.items()}
        fails = np.any(list(failing.values()), axis=0)
        best = np.where(fails & (shares > 0.5).any(0), shares.argmax(0), -1)
        main = self._main_rules(doc, n, kind, rule, best)
        return {k: v.tolist() for k, v in s.items()} | {f"{k}_share": shares[i].tolist() for i, k in enumerate(KINDS)} | {
            "kind": [KINDS[b] if b >= 0 else None for b in best], "kind_rule": main,
            "failures": [[k for k in LIMITS if failing[k][i]] if n_words[i] else [] for i in range(count)],
        }

    @staticmethod
    def _main_rules(doc: np.ndarray, n: np.ndarray, kind: np.ndarray, rule: np.ndarray, best: np.ndarray) -> list[str | None]:
        """For each document with a kind, the rule that named most of that kind's characters."""
        names, code = np.unique(rule.astype(str), return_inverse=True) if len(rule) else (np.array([""]), np.empty(0, int))
        own = (kind >= 0) & (kind == best[doc])
        totals = np.zeros((len(best), len(names)))
        np.add.at(totals, (doc[own], code[own]), n[own])
        return [str(names[totals[i].argmax()]) if best[i] >= 0 else None for i in range(len(best))]


def measure(df: DataFrame, id_column: str, text_column: str, common_words: DataFrame) -> DataFrame:
    """The statistics, the published rules that fail, and the kind of every row's text.

    ``common_words``: the fixed table with a column ``word``; the words of all languages count, as a text's language may be wrong.
    """
    common = [r.word for r in common_words.select("word").distinct().collect() if r.word]
    kind_of = df.schema[id_column].dataType.simpleString()
    schema = pa.schema([pa.field(k, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[t]) for k, t in _STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = Measure(common)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_CHARS)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a < b:
                    got = measured(batch.column(1).slice(a, b - a))
                    columns = [pa.array(got[f.name], f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=[id_column, *schema.names])

    declared = ", ".join([f"`{id_column}` {kind_of}", *[f"{k} {t}" for k, t in _STATS]])
    return spread(df.select(id_column, F.col(text_column).cast("string"))).mapInArrow(run, declared)
