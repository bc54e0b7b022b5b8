"""Keyword-stuffed pages, link lists and product-tag pages (problem 10).

Function words, which sentences have and lists do without, are learned from the
corpus: of each language, the words that most texts have, until they make up
``COVER`` of all words of its texts. Languages of few texts are taken together.

A text is cut into units (lines, sentences) and blocks of about ``BLOCK``
characters. Each block is compressed twice: as it is, and as its shape, in
which a link, a number and a content word become one symbol each and only
function words and punctuation stay. Repeated keywords shrink the first, lists
of links or tags of ever other words the second. Both ratios are divided by
the median of all blocks of the same language and length class, taken over the
whole corpus; a block far below it is extremely redundant.

A text's redundant blocks are confirmed by the density of sentences: ends of
sentences per character, where an end counts only if the unit reads like a sentence
(it has function words and does not repeat the text's dominating words). A function
word between two dominating words is part of a keyword ("caixa de som"); one that is
most of a text's function words belongs to names there and counts only in units that end like sentences; a text without known function
words and stuffed units is of an unknown language and has sentences if it has as
many ends of them. In a text
that may be a case, prose that stands by itself (``STRETCH`` sentences and more
between units of spam) makes blocks of its own, so that an introduction takes
nothing from the spam beside it. Last, an exact share is taken: the characters in
units of links, tags or stuffed keywords, in redundant blocks, must be ``SHARE`` of
the whole text. Units with numbers (order
lists, specifications, logs, stock tables), JSON and odd characters never count;
letters of one script are not odd, mixed scripts and symbols are.

Defined results: null, empty and blank texts and those of fewer than
``MIN_CHARS`` characters are no cases; a null language is a class of its
own; repeated texts are judged alike; repeated ids give a row each; writing
without blanks between words is odd.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

BLOCK = 2000
#: A block is redundant if one of its ratios is at most this part of the usual one.
RAW_CUT, SHAPE_CUT = 0.8, 0.75
#: Ratios that prose has at least, by length class from the one of 128 characters on: a corpus of copies is no measure of itself.
PROSE_RAW, PROSE_SHAPE = (0.78, 0.05), (0.26, 0.02)
#: Sentence ends per character; a block of sentences has about 0.013.
SENTENCES = 0.004
#: Sentences that follow one another without spam between them are prose beside it, not sentences within it.
STRETCH = 3
SHARE = 0.7
MIN_CHARS = 150

#: Share of a language's words, each counted once a text, that its function words make up.
COVER = 0.1
#: A word must stand in this share of a language's texts to be one.
SPREAD = 0.1
#: Languages of fewer texts are taken together.
LEAST_TEXTS = 50
#: Medians up to which they are sent to every task; more are joined by shuffling.
SENT_CLASSES = 20_000
#: Of a text's function words, the share above which one belongs to names.
MOST = 0.5
#: Function words per word below which a text is of an unknown language.
UNKNOWN = 0.02

_LINK = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]]*\]\([^)]*\)|(?:https?:)?//[^\s|]+|\bwww\.\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/\S*", re.I)
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]|<br\s*/?>|</?(?:p|div|li|ul|ol|h\d|td|tr|table)\b[^>]*>|(?<=[.!?…])\s+", re.I)
_MARKUP = re.compile(r"<[^>]*>|&\w+;")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|\n")
_JSON = re.compile(r'"[\w ]+"\s*:|^[\s{}\[\],]+$')
_UNUSUAL = re.compile(r"[^A-Za-zÀ-ɏ0-9\s.,;:!?#|/\\·•»>›\-–—()\[\]'’\"“”*+&@~_=]")
_DIGIT = re.compile(r"\d")
#: The box of a step to be ticked off.
_TASK = re.compile(r"\s*[-*]?\s*\[[ xX]\]")
_MARK = "\x00"
_SPAM = frozenset(["link", "stuffed", "tags"])
_END = re.compile(r"[.!?…][\"'”)]*\s*$")


def _scripts(text: str) -> int:
    """How many characters are no letters of the script that most letters are of, nor ordinary punctuation."""
    letters = [c for c in text if c.isalpha()]
    named = Counter(unicodedata.name(c, "").partition(" ")[0] for c in letters)
    unusual = _UNUSUAL.findall(text)
    if not named or named.most_common(1)[0][0] == "LATIN":
        return len(unusual)
    return len([c for c in unusual if not (c.isalpha() or unicodedata.combining(c))]) + len(letters) - named.most_common(1)[0][1]


def _unit_kind(raw: str, rest: str, words: list[str], links: int, dominating: set[str], functional: frozenset[str], plain: bool = False, names: frozenset[str] | set[str] = frozenset()) -> str:
    """One of link, data, none, odd, stuffed, sentence, tags; ``plain`` text has no unusual characters."""
    size = len(raw.strip())
    if links >= 0.5 * size:
        return "link"
    first = raw.lstrip()[0]
    if ('"' in raw or first in "{}[],") and _JSON.search(raw) or first in "-*[" and _TASK.match(raw):
        return "data"
    if not words:
        return "none"
    letters = sum(map(len, words))
    solid = len("".join(rest.split()))
    if max(map(len, words)) > 45 or letters < 0.6 * solid:
        return "odd"
    if not plain and len(_UNUSUAL.findall(rest)) > 0.07 * len(rest) and _scripts(rest) > 0.07 * len(rest):
        return "odd"
    n = len(words)
    if _DIGIT.search(rest) and len([w for w in words if not w.isalpha() and _DIGIT.search(w)]) >= max(1, 0.12 * n):
        return "data"
    function = sum(map(functional.__contains__, words))
    if function == 1 and n >= 6 and dominating:
        # A single one between two keywords is part of their name.
        function -= len([w for before, w, after in zip(words, words[1:], words[2:]) if w in functional and before in dominating and after in dominating])
    if dominating:
        repeated = Counter([w for w in words if w in dominating])
        if sum(repeated.values()) >= 0.3 * n and (not function or max(repeated.values()) >= 2 or names and function < 0.15 * n and not any(w in functional and w not in names for w in words)):
            return "stuffed"
    return "sentence" if function and function >= 0.08 * n else "tags"


def _links(unit: str) -> list[str]:
    return _LINK.findall(unit) if "/" in unit or "](" in unit or "ww." in unit.lower() else []


class _Symbols(dict):
    """Of each token its symbol in the shape, remembered up to a bound."""

    def __init__(self, functional: frozenset[str], bound: int = 200_000) -> None:
        super().__init__({"\n": "\n", _MARK: "L"})
        self.functional, self.bound = functional, bound

    def __missing__(self, token: str) -> str:
        low = token.lower()
        symbol = token if not token[0].isalnum() else low if low in self.functional else "0" if not token.isalpha() and _DIGIT.search(token) else "w"
        if len(self) < self.bound:
            self[token] = symbol
        return symbol


def _shape(rest: str, symbols: _Symbols) -> str:
    """Links, numbers and content words as one symbol each; ``rest`` has marks for its links."""
    return " ".join(map(symbols.__getitem__, _TOKEN.findall(rest))).replace(" \n ", "\n")


def _packed(text: str) -> int:
    """Compressed bytes without the container's fixed ones."""
    return max(1, len(zlib.compress(text.encode("utf-8", "replace"), 6)) - 8)


def measure(text: str, function_words: frozenset[str], symbols: _Symbols | None = None) -> list[tuple[int, int, int, int, int]]:
    """(chars, raw bytes, shape bytes, sentences, spam chars) of each block of a text."""
    units = []
    counts: Counter = Counter()
    total = 0
    plain = not _UNUSUAL.search(text)
    for raw in _BREAK.split(text):
        if not raw or not raw.strip():
            continue
        links = _links(raw)
        rest = _LINK.sub(f" {_MARK} ", raw) if links else raw
        if "<" in rest or "&" in rest:
            rest = _MARKUP.sub(" ", rest)
        words = _WORD.findall(rest.lower())
        counts.update(words)
        total += len(words)
        units.append((raw, rest, words, sum(map(len, links))))
    # A function word that is a fifth of a text and stands beside itself is a keyword there (a brand of that name).
    own = {w: c for w, c in counts.items() if w in function_words}
    frequent = {w for w, c in own.items() if c >= 15 and c >= 0.2 * total}
    keywords = {w for u in units for w, after in zip(u[2], u[2][1:]) if w == after and w in frequent} if frequent else frequent
    functional = function_words - keywords if keywords else function_words
    symbols = _Symbols(functional) if keywords or symbols is None else symbols
    in_all = sum(own.values())
    of_names = {w for w, c in own.items() if c >= 3 and c >= MOST * in_all}
    listed = functional - of_names if of_names else functional
    dominating = {w for w, c in counts.items() if c >= 4 and c >= 0.08 * total and w not in functional and not _DIGIT.search(w)}
    judged = [(u, _unit_kind(*u, dominating, functional if listed is functional or _END.search(u[0]) else listed, plain, of_names)) for u in units]
    if total >= 20 and in_all < UNKNOWN * total and all(k != "stuffed" for _, k in judged):
        ends = len([u for u in units if len(u[2]) >= 3 and _END.search(u[0])])
        if ends > SENTENCES * sum(len(u[0].strip()) for u in units):
            judged = [(u, "sentence" if k == "tags" else k) for u, k in judged]
    spam = sum(len(u[0].strip()) for u, k in judged if k in _SPAM)
    if spam < SHARE * sum(len(u[0].strip()) for u, _ in judged):
        return _blocks(judged, symbols)
    rest, prose = [], []
    for spammy, stretch in groupby(judged, lambda x: x[1] in _SPAM):
        held = list(stretch)
        (rest if spammy or sum(map(_ends, held)) < STRETCH else prose).extend(held)
    return _blocks(rest, symbols) + _blocks(prose, symbols)


def _ends(unit: tuple) -> bool:
    return unit[1] == "sentence" and bool(_END.search(unit[0][0]))


def _blocks(judged: list[tuple], symbols: _Symbols) -> list[tuple[int, int, int, int, int]]:
    """Units with their kinds to blocks of about ``BLOCK`` characters."""
    blocks, held = [], []

    def close() -> None:
        whole = "\n".join(u[0] for u, _ in held)
        spam = sum(len(u[0].strip()) for u, k in held if k in _SPAM)
        chars = sum(len(u[0].strip()) for u, _ in held)
        blocks.append((chars, _packed(whole), _packed(_shape("\n".join(u[1] for u, _ in held), symbols)), sum(map(_ends, held)), spam))
        held.clear()

    size = 0
    for unit in judged:
        held.append(unit)
        size += len(unit[0][0])
        if size >= BLOCK:
            close()
            size = 0
    if held:
        close()
    return blocks


_BLOCKS = pa.list_(pa.struct([("size_class", pa.int32()), ("chars", pa.int64()), ("raw", pa.float64()), ("shape", pa.float64()), ("sentences", pa.int64()), ("spam", pa.int64())]))


def _measure_batches(batches: Iterator[pa.RecordBatch], function_words: frozenset[str]) -> Iterator[pa.RecordBatch]:
    symbols = _Symbols(function_words)
    for b in batches:
        out = []
        for text in b.column(2).to_pylist():
            found = []
            for chars, raw, shape, ends, spam in measure(text, function_words, symbols):
                found.append({"size_class": int(2 * math.log2(max(min(chars, BLOCK), 1))), "chars": chars, "raw": raw / max(chars, 1), "shape": shape / max(chars, 1), "sentences": ends, "spam": spam})
            out.append(found)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _BLOCKS)], ["key", "lang", "blocks"])


def learn_function_words(rows: DataFrame) -> DataFrame:
    """(word) of ``rows`` (lang, text): of each language the words of most texts that make up COVER of all, in one pass and without moving texts.

    A word of fewer than SPREAD of a language's texts is none, which leaves at
    most a text's number of words by 1 / SPREAD to be ordered. Of equally common
    words the shorter come first.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}'’]+"))
    # Each text also has one mark, which counts the texts.
    each = rows.select("lang", F.explode(F.array_append(words, F.lit(_MARK))).alias("word")).where(F.length("word") > 0)
    by_lang = materialize(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df")), "words")
    kind = by_lang.where(F.col("word") == _MARK).select("lang", F.when(F.col("df") >= LEAST_TEXTS, F.col("lang")).otherwise("\0few").alias("kind"))
    kinds = by_lang.join(kind, "lang").groupBy("kind", "word").agg(F.sum("df").alias("df"))
    counted, sizes = kinds.where(F.col("word") != _MARK), kinds.where(F.col("word") == _MARK).select("kind", F.col("df").alias("texts"))
    total = counted.groupBy("kind").agg(F.sum("df").alias("total"))
    common = counted.join(sizes, "kind").where(F.col("df") >= F.greatest(F.lit(2), SPREAD * F.col("texts"))).join(total, "kind")
    before = Window.partitionBy("kind").orderBy(F.desc("df"), F.length("word"), "word").rowsBetween(Window.unboundedPreceding, -1)
    return common.withColumn("sum", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("sum") < COVER * F.col("total")).select("word").distinct()


def stuffed_pages(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, share): the rows whose text is made of keywords, links or tags, and to what share."""
    rows = docs.select(F.col(key).alias("key"), F.lower(F.btrim(F.coalesce(F.col(lang), F.lit("")))).alias("lang"), F.col(text).alias("text")).where(F.length(F.btrim("text")) > 0)
    kind = rows.schema["key"].dataType.simpleString()
    # A few dozen words of each language.
    function_words = frozenset(r[0] for r in learn_function_words(rows.select("lang", "text")).collect())
    # Texts are measured whole; what is written are numbers. Keys may repeat, so rows are numbered.
    measured = rows.mapInArrow(lambda it: _measure_batches(it, function_words), f"key {kind}, lang string, blocks array<struct<size_class:int,chars:bigint,raw:double,shape:double,sentences:bigint,spam:bigint>>")
    numbered = materialize(measured.withColumn("row", F.monotonically_increasing_id()), "spam-blocks")
    blocks = numbered.select("row", "lang", F.inline("blocks"))
    # The usual ratios: one row per language and length class, of which there are 22.
    medians = [F.percentile_approx(c, 0.5, 1000) for c in ("raw", "shape")]
    usual = blocks.groupBy("lang", "size_class").agg(*[m.alias(a) for m, a in zip(medians, ("usual_raw", "usual_shape"))])
    usual = materialize(usual, "usual-ratios")
    # As many rows as languages, times 22; sent to all tasks if they are few.
    few = usual.count() <= SENT_CLASSES
    judged = blocks.join(F.broadcast(usual) if few else usual, ["lang", "size_class"])
    # A class of few blocks, or mostly of spam, has no say: those of all languages, of it and its neighbours in length, are the floor.
    wide = blocks.withColumn("size_class", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1)))
    overall = wide.groupBy("size_class").agg(*[m.alias(a) for m, a in zip(medians, ("all_raw", "all_shape"))])
    longer = F.col("size_class") - 14
    judged = judged.join(F.broadcast(overall), "size_class")
    judged = judged.withColumn("usual_raw", F.greatest("usual_raw", "all_raw", PROSE_RAW[0] - PROSE_RAW[1] * longer)).withColumn("usual_shape", F.greatest("usual_shape", "all_shape", PROSE_SHAPE[0] - PROSE_SHAPE[1] * longer))
    redundant = (F.col("raw") <= RAW_CUT * F.col("usual_raw")) | (F.col("shape") <= SHAPE_CUT * F.col("usual_shape"))
    # Density of sentences over all blocks of a text that hold spam.
    beside = [F.sum(F.when(F.col("spam") > 0, F.col(c)).otherwise(0)).alias(f"run_{c}") for c in ("sentences", "chars")]
    per_text = judged.groupBy("row").agg(F.sum("chars").alias("chars"), F.sum(F.when(redundant, F.col("spam")).otherwise(0)).alias("spam"), *beside)
    confirmed = F.col("run_sentences") <= SENTENCES * F.col("run_chars")
    found = per_text.where(confirmed & (F.col("chars") >= MIN_CHARS) & (F.col("spam") >= SHARE * F.col("chars")))
    shares = found.select("row", (F.col("spam") / F.col("chars")).alias("share"))
    return numbered.select("row", "key").join(shares, "row").select(F.col("key").alias(key), "share")
