"""Defective prompt-response pairs, with the defect of each.

Distinct responses are sorted by text over range partitions, and each is
compared with its neighbours, ``NEAR`` on each side, across partitions, too. A
response without an end that goes on after the words it shares with them is a
shortened sentence if more of them are ended than are not. It is cut
inside a word if the next one is the same and goes on with a letter, and its last
word is none that stands whole in any response or is common. A response that
another one only ends with a full stop is whole. Lengths at which far more
distinct responses break off than at the lengths around are limits: a response of
that length is cut if it begins another one, or has any ended neighbour. A comma,
dots, a dash or an opening bracket at the end, an unclosed quotation or bracket, and
a last word that needs another one after it are signs of their own.

Empty, copied, refusing and foreign responses come first; a pair has the first
defect that holds. Names (New York, Vincent van Gogh) and short answers are whole.

Defined cases: null, empty and blank responses and those without letter or digit
are ``empty``; a null response of a withheld split is no case; a null question
can't be copied and has no language; null pairs and turns are skipped; repeated
rows of a record count once; very long responses are read whole; ties between
languages are no defect; responses of one word are not judged to break off;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.joins import hot_join, hot_keys
from lumenweave.storage import write_table

WITHHELD = ("test", "teststd", "testdev")
#: Sorted neighbours on each side that a response is compared with.
NEAR = 12
#: Pairs in a file of the table that is judged: a bound on a task's rows only.
FILE_ROWS = 20_000

_TERMINAL = r"""[.!?。！？][\s"'”’»)\]」』]*$"""
#: First person, or the assistant, and a refusal. Quoted words are removed before.
_ENGLISH_REFUSAL = (
    r"\b(?:i|we)(?:'m| am|'ve| have| are|'re)? (?:really |simply |afraid i )?(?:can't|cannot|can not|could not|couldn't|won't|will not|unable|not able|not permitted|not allowed|not authori[sz]ed|must (?:decline|refuse)|(?:been )?(?:asked|told|instructed) not|do not have (?:enough )?permission|don't have (?:enough )?permission|prefer not|would prefer not|would rather not|decline|refuse|not comfortable|not going to)\b"
    r"|\bi(?:'d| would) (?:rather|prefer) not\b|\bas an? (?:ai|assistant|language model)\b.*\b(?:not|can't|cannot|won't|unable|refuse|decline)\b"
    r"|\bmy (?:\w+ )?(?:guidelines|policy|policies|rules|instructions)\b.*\b(?:not|don't|doesn't|prevent|forbid|prohibit)|\bagainst my (?:\w+ )?(?:policy|policies|guidelines|rules|instructions)\b"
    r"|\bnot (?:be )?appropriate for me\b|\bsomething i (?:prefer|would prefer|'d prefer) not\b|\bthis (?:request|question) (?:can't|cannot|won't|will not) be (?:completed|answered|fulfilled|processed)\b"
)
_OTHER_REFUSALS = (
    r"\b(?:kann|darf|möchte|werde|will) ich\b.*\bnicht\b|\bich (?:kann|darf|möchte|werde|bin)\b.*\bnicht\b|\btut mir leid\b",
    r"\bje ne (?:peux|puis|suis|veux|dois|souhaite|saurais|vais)\b|\bje (?:suis )?(?:désolée?|regrette)\b|\bil ne m'est pas (?:permis|possible)\b|\bje refuse\b",
    r"\blo siento\b|\bno (?:puedo|debo|quiero|deseo)\b|\bno me (?:está|es|han) (?:permitido|posible)\b|\bno estoy (?:autorizad|en condiciones)|\bme niego\b",
    r"\bmi dispiace\b|\bnon (?:posso|devo|voglio|intendo)\b|\bnon mi è (?:permesso|consentito|possibile)\b|\bnon sono (?:in grado|autorizzat|abilitat)",
    r"я не (?:могу|вправе|имею права|буду|должен|должна)|мне (?:не разрешено|нельзя|запрещено)|не (?:могу|имею права) (?:ответить|помочь|обсуждать|говорить|описать)|извините",
    r"できません|できかね|いたしかね|申し訳|お断り|控えさせて|お答えでき",
)
#: Answers that only tell what can't be seen or done, and what a group can't do.
_UNABLE = regex.compile(
    r"\b(?:i|we|you) (?:can't|cannot|can not|could not|couldn't) (?:really |quite |clearly )?(?:see|find|spot|notice|hear|make out|recogni[sz]e|read|pass|go|move|get|reach|fit|enter|leave|cross|stop|swim)\b(?! (?:any |the |this |that )?(?:images?|pictures?|photos?)\b)"
    r"|\b(?:kann ich|ich kann)\b[^.!?]*\bnicht (?:sehen|finden|erkennen|lesen)\b|\bje ne peux pas (?:voir|trouver|lire)\b|\bno puedo (?:ver|encontrar|leer)\b|\bnon posso (?:vedere|trovare|leggere)\b|я не могу (?:увидеть|найти|прочитать)"
)
_REFUSAL = regex.compile("|".join([_ENGLISH_REFUSAL, *_OTHER_REFUSALS]))
_QUOTED = regex.compile(r'"[^"]*"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」')
_ASKED = regex.compile(r"^\W*(?:question|q|prompt|frage|pregunta|domanda|вопрос|質問)\s*[:：.\-]\s*", regex.I)
_ANSWERED = regex.compile(r"[\s\W]*\b(?:answer|a|antwort|réponse|respuesta|risposta|ответ|回答)\s*[:：]\s*$", regex.I)
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_HANGING = frozenset("a an the of to in on at by with and or but for from which that while because as is are was were el la le les un une una der die das ein eine und de du des con y e il lo gli с и на в".split())
_OPEN_ENDS = regex.compile(r"(?:\.\.\.|…|[,:;(\[{«“„\-–—&/])\s*$")


def _kept(f):
    """``f`` with a memory for its results on texts of usual length."""
    short = lru_cache(50_000)(f)
    return lambda text: short(text) if len(text) <= 500 else f(text)


def plain_question(text: str | None) -> str:
    return re.sub(r"\s*<image>\s*", " ", text or "").strip()


_NOT_ALPHANUMERIC = re.compile(r"[\W_]+")


def _bare(text: str) -> str:
    return _NOT_ALPHANUMERIC.sub("", text.casefold())


def is_copy(question: str, answer: str) -> bool:
    """Nothing but the question again, once or several times, however it is written."""
    q = _bare(question)
    if not q:
        return False
    body = _ASKED.sub("", answer)
    for text in dict.fromkeys((answer, body, _ANSWERED.sub("", body), _ANSWERED.sub("", answer))):
        a = _bare(text)
        if a and len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
            return True
    return False


@_kept
def is_refusal(answer: str) -> bool:
    text = regex.sub(r"\s+", " ", _QUOTED.sub(" ", answer.replace("’", "'")).casefold())
    return bool(_REFUSAL.search(_UNABLE.sub(" ", text)))


class Languages:
    """Guesses a text's language from its script and its common words."""

    def __init__(self, common: list[tuple[str, str]]) -> None:
        languages: dict[str, set[str]] = {}
        for lang, word in common:
            languages.setdefault(word.casefold(), set()).add(lang)
        self.weight = {w: (tuple(sorted(ls)), 1.0 / len(ls)) for w, ls in languages.items()}
        self.asked = _kept(self.guess)
        self.given = _kept(lambda text: self.guess(_QUOTED.sub(" ", text)))

    def guess(self, text: str) -> tuple[str | None, float, int]:
        """``(language or None, how far it leads, words)``."""
        letters = cyrillic = 0
        if not text.isascii():
            kana = sum("぀" <= c <= "ヿ" for c in text)
            han = sum("一" <= c <= "鿿" for c in text)
            letters = sum(c.isalpha() for c in text)
            cyrillic = sum("Ѐ" <= c <= "ӿ" for c in text)
            if letters and (kana + han) * 2 > letters:
                return ("ja" if kana else None), float(kana), letters
        words = [w.replace("’", "'").casefold() for w in _WORDS.findall(text)]
        if letters and cyrillic * 2 > letters:
            return "ru", float(len(words)), len(words)
        score: Counter[str] = Counter()
        for w in words:
            # Elided articles count by their second part, too: n'est, l'homme.
            for part in {w, w.split("'")[-1]} if "'" in w else (w,):
                if part in self.weight:
                    ls, weight = self.weight[part]
                    for lang in ls:
                        score[lang] += weight
        if not score:
            return None, 0.0, len(words)
        (first, a), *rest = score.most_common(2)
        return first, a - (rest[0][1] if rest else 0.0), len(words)

    def question(self, text: str) -> str | None:
        lang, lead, _ = self.asked(text)
        return lang if lead > 0 else None

    def differs(self, question: str, answer: str) -> bool:
        asked = self.question(question)
        if asked is None:
            return False
        given, lead, words = self.given(answer)
        if given is None or given == asked:
            return False
        if given in ("ja", "ru") or asked in ("ja", "ru"):
            return words >= 2 and (given in ("ja", "ru") or lead >= 1)
        return words >= 3 and lead >= 1


def is_ended(text: str) -> bool:
    return bool(re.search(_TERMINAL, text)) and not re.search(r"(?:\.\.\.|…)\s*$", text)


def is_name(text: str) -> bool:
    """Words that all begin with a capital, but for short ones inside: a name has no sentence to complete."""
    words = text.split()
    return all(w[:1].isupper() or (0 < i < len(words) - 1 and len(w) <= 3 and w.isalpha()) for i, w in enumerate(words))


def leading(text: str) -> tuple[str | None, bool]:
    """The first two words (four characters of a script without spaces), and whether the text goes on after them."""
    words = text.split(None, 2)
    if len(words) >= 2:
        return f"{words[0]} {words[1]}", len(words) == 3
    cased = next((c for c in text if c.isalpha()), "a")
    if len(text) >= 6 and cased.lower() == cased.upper():
        return text[:4], True
    return None, False


def own_signs(text: str) -> str | None:
    """``open``: the end itself leaves the sentence open. ``hint``: a last word or an unclosed mark does, unless another response shows the text whole."""
    if is_ended(text):
        return None
    words = text.split()
    if _OPEN_ENDS.search(text):
        return "open" if len(words) >= 2 else None
    if len(words) >= 2 and words[-1].casefold() in _HANGING:
        return "hint"
    return "hint" if text.count('"') % 2 or text.count("(") > text.count(")") else None


def defect_of(question: str | None, answer: str | None, languages: Languages) -> str | None:
    """The defect that a pair shows by itself: ``truncated`` by an open end; ``hint`` and ``unended`` where its neighbours decide."""
    if answer is None or not any(c.isalnum() for c in answer):
        return "empty"
    text, asked = answer.strip(), plain_question(question)
    if is_copy(asked, text):
        return "copy"
    if is_refusal(text):
        return "refusal"
    if languages.differs(asked, text):
        return "other_language"
    sign = own_signs(text)
    if sign == "open":
        return "truncated"
    return sign or (None if is_ended(text) or leading(text)[0] is None else "unended")


def pairs_of(records: DataFrame) -> DataFrame:
    """``record_id, field_name, pos, question, answer`` of every pair that may be a case."""
    withheld = F.coalesce(F.col("split").isin(*WITHHELD), F.lit(False))
    qa = records.select("record_id", withheld.alias("w"), F.posexplode("qa_pairs")).filter("col IS NOT NULL")
    qa = qa.select("record_id", "w", F.lit("qa_pairs").alias("field_name"), "pos", F.col("col.question").alias("question"), F.col("col.answer").alias("answer"))
    turns = records.filter("chat IS NOT NULL").select("record_id", withheld.alias("w"), "chat", F.posexplode("chat")).filter("col.role = 'gpt' AND pos > 0 AND chat[pos - 1].role = 'human'")
    chat = turns.select("record_id", "w", F.lit("chat").alias("field_name"), "pos", F.expr("chat[pos - 1].text").alias("question"), F.col("col.text").alias("answer"))
    return qa.unionByName(chat).filter("NOT (w AND answer IS NULL)").select("record_id", "field_name", F.col("pos").cast("long").alias("pos"), "question", "answer")


def _bare_end(c: str) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


#: A word's characters, and the last word of a text that has more.
_RUN = r"[\p{L}\p{M}\p{N}]+"
_LAST = r"(?<=[\s\p{Z}])[\p{L}\p{M}\p{N}]+$"
_FLAGS = ("shortened", "completed", "in_word", "in_sentence", "by_ended")
_SIGNALS = "text string, " + ", ".join(f"{f} boolean" for f in _FLAGS)
_COMPARED = f"{_SIGNALS}, edge boolean, part int, place long"


def continues(short: str, longer: str) -> tuple[bool, bool]:
    """``(shortened, completed)``: the longer text goes on in words, or only ends the sentence."""
    rest = longer[len(short) :].strip()
    return any(c.isalnum() for c in rest), bool(re.fullmatch(r"""[.!?。！？]["'”’»)]*""", rest))


def goes_on_in_word(short: str, longer: str) -> bool:
    """Whether the longer text goes on with a letter directly after one; scripts without case have no words to cut."""
    return all(c.isalpha() and c.lower() != c.upper() for c in (short[-1:], longer[len(short) :][:1]))


class _Known:
    """A sorted text with what comparing it needs."""

    __slots__ = ("text", "ended", "lead", "goes_on")

    def __init__(self, text: str) -> None:
        self.text, self.ended = text, is_ended(text)
        self.lead, self.goes_on = leading(text)


def signals_of(around: list[_Known], at: int) -> tuple[bool, ...] | None:
    """The signals of the text at a place among its sorted neighbours; None if there are none or it is ended."""
    own = around[at]
    if own.ended:
        return None
    shortened = completed = in_word = False
    ended = unended = 0
    for step, places in ((-1, range(at - 1, max(-1, at - NEAR - 1), -1)), (1, range(at + 1, min(len(around), at + NEAR + 1)))):
        for k in places:
            other = around[k]
            begins = step == 1 and other.text.startswith(own.text)
            if begins:
                goes_on, ends = continues(own.text, other.text)
                shortened, completed = shortened or goes_on, completed or ends
                in_word = in_word or goes_on_in_word(own.text, other.text)
            same = own.goes_on and other.lead == own.lead
            if not (begins or same):
                break
            if same:
                ended, unended = ended + other.ended, unended + (not other.ended)
    named = is_name(own.text)
    found = (shortened, completed, in_word, not named and ended > unended, not named and ended > 0)
    return found if any(found) else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["text", *_FLAGS, "edge", "part", "place"]
    kinds = [pa.string(), *[pa.bool_()] * (len(_FLAGS) + 1), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


_NONE = (False,) * len(_FLAGS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts against their neighbours in the partition; its first and last ``2 * NEAR`` also come out as edges."""
    from pyspark import TaskContext

    part, held, start, done, out = TaskContext.get().partitionId(), [], 0, NEAR, []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(_Known(text))
            if start + len(held) <= 2 * NEAR:
                out.append((text, *_NONE, True, part, start + len(held) - 1))
        # Those with all their neighbours on both sides; the others wait, or are edges.
        while done < start + len(held) - NEAR:
            if found := signals_of(held, done - start):
                out.append((held[done - start].text, *found, False, part, done))
            done += 1
        if len(held) > 4_096 + 2 * NEAR:
            gone = len(held) - 2 * NEAR
            held, start = held[gone:], start + gone
        if out:
            yield _batch(out)
            out = []
    last = [(k.text, *_NONE, True, part, start + i) for i, k in enumerate(held) if start + i >= max(2 * NEAR, start + len(held) - 2 * NEAR)]
    # The number of the partition's texts tells which edges lie where.
    yield _batch([*last, ("", *_NONE, True, part, -1 - start - len(held))])


def _compare_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last ``NEAR`` texts of each partition against their neighbours across its borders.

    Gets the edges in order, each partition's count first; a partition has at most ``4 * NEAR`` edges.
    """
    run: list[_Known] = []
    judged: list[int] = []

    def judge() -> list[tuple]:
        rows = [(run[i].text, *found, False, 0, 0) for i in judged if (found := signals_of(run, i))]
        run.clear()
        judged.clear()
        return rows

    n = previous = 0
    for batch in batches:
        out = []
        for text, place in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist(), strict=True):
            if place < 0:
                n, previous = -1 - place, -1
                continue
            if place != previous + 1:  # what lies between was compared within the partition
                out += judge()
            previous = place
            if place < NEAR or place >= n - NEAR:
                judged.append(len(run))
            run.append(_Known(text))
        if out:
            yield _batch(out)
    if judged and (out := judge()):
        yield _batch(out)


def neighbours(responses: DataFrame, *, parts: int) -> DataFrame:
    """``text, shortened, completed, in_word, in_sentence, by_ended`` of unended texts to which their sorted neighbours say something."""
    ordered = responses.repartitionByRange(parts, "text").sortWithinPartitions("text")
    compared = write_table(ordered.mapInArrow(_compare, _COMPARED), "neighbours")
    # A bounded number of texts for each partition: one task reads them in order.
    edges = compared.filter("edge").select("text", "part", "place").repartition(1).sortWithinPartitions("part", "place")
    across = edges.mapInArrow(_compare_edges, _COMPARED)
    return compared.filter("NOT edge").select("text", *_FLAGS).unionByName(across.select("text", *_FLAGS))


def cut_words(signals: DataFrame, responses: DataFrame, common: list[tuple[str, str]]) -> DataFrame:
    """``signals`` with ``inside_word``: the text goes on in its last word, which no response has whole and which isn't common.

    ``responses``: all distinct texts. The last word of a text of several words may be cut itself, and doesn't count.
    """
    ends = signals.withColumn("word", F.when(F.col("in_word"), F.lower(F.regexp_extract("text", _LAST, 0))))
    asked = ends.filter("word <> ''").select("word").distinct()
    whole = responses.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("text", _LAST, "")), F.lit(_RUN), F.lit(0)))).alias("word"))
    listed = signals.sparkSession.createDataFrame([(w.lower(),) for _, w in common], "word string")
    known = whole.unionByName(listed).join(asked, "word", "left_semi").distinct().withColumn("known", F.lit(True))
    inside = F.col("in_word") & (F.col("word") != "") & F.col("known").isNull()
    return ends.join(known, "word", "left").select("text", "shortened", "completed", "in_sentence", "by_ended", F.coalesce(inside, F.lit(False)).alias("inside_word"))


def length_limits(texts: DataFrame, *, least: int = 20, times: float = 4.0, around: int = 4) -> DataFrame:
    """Lengths at which far more of the distinct texts break off than at the lengths around: ``n_chars``."""
    unended = texts.filter(~F.col("text").rlike(_TERMINAL))
    counts = unended.groupBy(F.length("text").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))
    near = Window.orderBy("n_chars").rangeBetween(-around, around)  # one row for each length
    spike = counts.withColumn("_near", (F.sum("n").over(near) - F.col("n")) / (2 * around))
    return spike.filter((F.col("n") >= least) & (F.col("n") > times * F.greatest("_near", F.lit(1.0)))).select("n_chars")


def _judge(common: list[tuple[str, str]]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(common)
        for batch in batches:
            found, defects = [], []
            for i, (question, answer) in enumerate(zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist(), strict=True)):
                if defect := defect_of(question, answer, languages):
                    found.append(i)
                    defects.append(defect)
            if found:
                kept = batch.take(pa.array(found))
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in ("record_id", "field_name", "pos")], pa.array(defects), kept.column("text")], names=["record_id", "field_name", "pos", "defect", "text"])

    return judge


def defective_pairs(records: DataFrame, common_words: DataFrame, *, hot_share: float = 1e-4, hot_rows: int = 10_000) -> DataFrame:
    """``record_id, field_name, pos, defect`` of every defective pair. ``common_words``: the fixed table ``lang, word``.

    ``hot_share, hot_rows``: see ``hot_keys``; a text with more pairs is joined without shuffling them.
    """
    spark = records.sparkSession
    common = [(r.lang, r.word) for r in common_words.select("lang", "word").distinct().collect() if r.lang and r.word]
    pairs = write_table(pairs_of(records), "pairs", file_rows=FILE_ROWS)
    text = _bare_end("answer")
    texts = write_table(pairs.filter("answer IS NOT NULL").groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n")), "texts")
    # Texts of one word have nothing to share with a neighbour but themselves; scripts without spaces have no such words.
    several = F.col("text").rlike(r"[\s\p{Z}]|[^\p{Lu}\p{Ll}\p{N}\p{P}]{6,}")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = write_table(neighbours(texts.filter(several).select("text"), parts=parts), "signals")
    signals = cut_words(near, texts, common)
    limits = [r.n_chars for r in length_limits(texts.filter(several)).collect()]  # a few lengths

    is_filled = F.coalesce(F.col("answer").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    keys = ["record_id", "field_name", "pos"]
    empty = pairs.filter(~is_filled).select(*keys, F.lit("empty").alias("defect"))
    filled = pairs.filter(is_filled).select(*keys, "question", "answer", text.alias("text"))
    judged = write_table(filled.mapInArrow(_judge(common), "record_id long, field_name string, pos long, defect string, text string"), "judged")
    by_itself = judged.filter("defect NOT IN ('hint', 'unended')").select(*keys, "defect")
    hot = hot_keys(texts.select("text", "n"), "n", texts.agg(F.sum("n")).first()[0] or 0, hot_share=hot_share, hot_rows=hot_rows)
    open_pairs = hot_join(judged.filter("defect IN ('hint', 'unended')"), signals, ["text"], hot, "left")
    at_limit = F.length("text").isin(limits) if limits else F.lit(False)
    cut = (F.col("defect") == "hint") | F.col("in_sentence") | F.col("inside_word") | (at_limit & (F.col("shortened") | F.col("by_ended")))
    truncated = open_pairs.filter(F.coalesce(cut & ~F.coalesce("completed", F.lit(False)), F.lit(False))).select(*keys, F.lit("truncated").alias("defect"))
    return empty.unionByName(by_itself).unionByName(truncated).dropDuplicates(keys)
