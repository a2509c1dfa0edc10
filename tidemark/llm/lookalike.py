"""Problem 9: texts that look the same get one consistent form.

1. Compatibility normalisation: width, no-break and ligature forms become ordinary
   characters, every blank becomes a space (one for one), hyphen variants become a
   hyphen. Forms that look different (superscripts, fractions, enclosed, styled) stay.
2. Ignorable characters are deleted; a joiner between pictographs stays.
3. Every look-alike letter is replaced by its shape, which is the Latin letter. This is
   all that two equal-looking texts have in common, so the form depends on it alone.
4. The shape of a token is a lattice: each letter may be the Latin one or its twins in
   the scripts that the text proves by a letter without a Latin twin. Viterbi takes the
   path with the best score under character bigrams of each script, counted over all
   documents; changing the script inside a token costs what the counts say of neighbouring
   letters of two scripts. Without such proof the lattice has one path, the Latin one.
5. Composition (NFC).

Equal shapes give equal forms by construction, whatever the model says. Defined
results: null stays null, empty stays empty; case, digits, accents and the number of
blanks are kept; texts of any length are handled whole.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

# A Latin letter and the letters of other alphabets with its shape.
TWINS = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ",
    "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ",
    "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ",
    "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
# The same for alphabets that have capitals of Latin shape, and for a second form of a.
MORE_TWINS = {
    "a": "ɑ", "c": "ⲥ", "o": "ⲟ", "p": "ⲣ", "A": "Ꭺ", "B": "ᏴⲂ", "C": "ᏟⲤ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "ᎻⲎ", "I": "Ⲓ", "J": "Ꭻ",
    "K": "ᏦⲔ", "L": "Ꮮ", "M": "ᎷⲘ", "N": "Ⲛ", "O": "Ⲟ", "P": "ᏢⲢ", "R": "Ꭱ", "S": "Ꮪ", "T": "ᎢⲦ", "V": "Ꮩ", "W": "Ꮃ", "X": "Ⲭ", "Y": "Ⲩ", "Z": "ᏃⲌ",
}
HYPHENS = "‐‑‒﹣－⁃−˗"
# Letters whose compatibility form has another shape.
OWN_LOOK = "ſϐϑϒϓϔϕϖϰϱϲϴϵϹẛ"
#: Kinds of compatibility forms that look like the ordinary character.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}


def _normal_table() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in range(0xA0, sys.maxunicode + 1):
        ch = chr(code)
        category = unicodedata.category(ch)
        if category == "Zs":
            table[code] = " "
        elif category == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            table[code] = ""
        elif ch not in OWN_LOOK and unicodedata.decomposition(ch).partition(" ")[0] in _SAME_LOOK:
            plain = unicodedata.normalize("NFKC", ch)
            if not plain.startswith(" "):
                table[code] = plain
    for ch in HYPHENS:
        table[ord(ch)] = "-"
    for code in (0x200D, 0xFE0E, 0xFE0F):
        table[code] = ""
    return table


_SCRIPTS = (("cyrillic", 0x0400, 0x052F), ("greek", 0x0370, 0x03FF), ("armenian", 0x0530, 0x058F), ("coptic", 0x2C80, 0x2CFF), ("cherokee", 0x13A0, 0x13FF))
_ALL_TWINS = {latin: TWINS.get(latin, "") + MORE_TWINS.get(latin, "") for latin in {**TWINS, **MORE_TWINS}}


def script_of(ch: str) -> str:
    """The script of a letter, as far as the look-alikes need it."""
    code = ord(ch)
    return next((name for name, lo, hi in _SCRIPTS if lo <= code <= hi), "latin" if ch.isalpha() else "")


_NORMAL = _normal_table()
_SHAPE = {ord(t): latin for latin, twins in _ALL_TWINS.items() for t in twins}
#: Shape -> script -> letter (the first twin of the script).
_CHOICES: dict[str, dict[str, str]] = {}
for _latin, _twins in _ALL_TWINS.items():
    for _t in _twins:
        _CHOICES.setdefault(_latin, {"latin": _latin}).setdefault(script_of(_t), _t)
_JOINED = re.compile("(?<=[☀-➿️\U0001f000-\U0001faff])‍(?=[☀-➿\U0001f000-\U0001faff])")
_KEEP = ""
_PROOF = {name: re.compile("[" + "".join(chr(c) for c in range(lo, hi + 1) if chr(c).isalpha() and c not in _SHAPE and len(unicodedata.normalize("NFD", chr(c))) == 1) + "]") for name, lo, hi in _SCRIPTS}
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
#: Words joined by these are one lattice, where changing the script costs less.
_COMPOUND = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ]|[-_./:@](?=[^\W\d_]))*")
_LINKS = set("-_./:@")


def _special() -> re.Pattern:
    """Matches every character that may change a text or prove a script; a text without
    any is its own form."""
    codes = {c for _, lo, hi in _SCRIPTS for c in range(lo, hi + 1)} | _NORMAL.keys() | _SHAPE.keys()
    for code in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= code <= 0xDFFF and not 0xAC00 <= code <= 0xD7A3:
            ch = chr(code)
            if unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or any(ord(x) in _SHAPE for x in unicodedata.normalize("NFD", ch)):
                codes.add(code)
    ranges, ordered = [], sorted(codes)
    for code in ordered:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    # Conjoining jamo compose without being combining characters.
    return re.compile("[ᄀ-ᇿ" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


_SPECIAL = _special()
#: The cost of another script inside a word, if none was counted, and behind a link.
_SWITCH, _SWITCH_AT_LINK = 1000.0, 12.0
#: Lower-case letters whose capital has a twin: what a comparison without case must join.
_CASELESS = {ord(t.lower()): latin.lower() for latin, twins in _ALL_TWINS.items() for t in twins if ord(t.lower()) not in _SHAPE}


def shape(text: str) -> str:
    """The decomposed text with every letter replaced by its shape."""
    if "‍" in text:
        text = _JOINED.sub(_KEEP, text)
    return unicodedata.normalize("NFD", text.translate(_NORMAL)).translate(_SHAPE)


def caseless(text: str) -> str:
    """A key that is equal for texts that look alike without regard to case."""
    if text.isascii() or not _SPECIAL.search(text):
        return text.lower()
    return unicodedata.normalize("NFC", shape(text).lower().translate(_CASELESS))


class Forms:
    """Texts to their consistent form. ``model``: (script, a, b) -> log probability."""

    def __init__(self, model: dict[tuple[str, str, str], float] | None = None, limit: int = 200_000) -> None:
        self.model = model or {}
        self.switch = self.model.get(("switch", "", ""), -_SWITCH)
        self.cache: dict[tuple[tuple[str, ...], str], str] = {}
        self.limit = limit

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii() or not _SPECIAL.search(text):
            return text
        drawn = shape(text)
        proven = tuple(name for name, pattern in _PROOF.items() if pattern.search(drawn))
        if proven:
            if len(self.cache) > self.limit:
                self.cache.clear()
            drawn = _COMPOUND.sub(lambda m: self._token(m.group(), proven), drawn)
        return unicodedata.normalize("NFC", drawn).replace(_KEEP, "‍")

    def _token(self, token: str, proven: tuple[str, ...]) -> str:
        key = (proven, token)
        found = self.cache.get(key)
        if found is None:
            found = self.cache[key] = self._viterbi(token, proven)
        return found

    def _viterbi(self, token: str, proven: tuple[str, ...]) -> str:
        # A state is the letter last written; marks stay with their letter. Scores:
        # log bigrams within a script; ties go to the script named first.
        order = {s: -1e-9 * i for i, s in enumerate((*proven, "latin"))}
        states: list[tuple[float, str, str, str]] = []
        for ch in token:
            if unicodedata.combining(ch):
                states = [(score, script, last, out + ch) for score, script, last, out in states]
                continue
            if ch in _LINKS:
                states = [(score, script, "^", out + ch) for score, script, last, out in states]
                continue
            twins = _CHOICES.get(ch)
            options = [(s, twins[s]) for s in ("latin", *proven) if s in twins] if twins else [(script_of(ch), ch)]
            after = []
            for script, letter in options:
                low = letter.lower()
                if not states:
                    after.append((self._log(script, "^", low) + order.get(script, 0.0), script, low, letter))
                    continue
                after.append(
                    max(
                        (score + self._step(s, script, last, low), script, low, out + letter)
                        for score, s, last, out in states
                    )
                )
            states = after
        return max(states)[3]

    def _step(self, before: str, script: str, last: str, low: str) -> float:
        if last == "^":
            return self._log(script, "^", low) - (0.0 if before == script else _SWITCH_AT_LINK)
        return self._log(script, last, low) if before == script else self.switch + self._log(script, "^", low)

    def _log(self, script: str, a: str, b: str) -> float:
        return self.model.get((script, a, b), -12.0)


#: The letters counted, the start of a word first; numbers and scripts by code point.
_LETTERS = ["^", *(chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x250), *range(0x370, 0x590)) if chr(c).isalpha() and chr(c).lower() == chr(c))]
_NUMBER = np.zeros(0x10000, np.int64)
_NUMBER[[ord(c) for c in _LETTERS[1:]]] = np.arange(1, len(_LETTERS))
_SCRIPT = np.zeros(0x10000, np.int64)
_SCRIPT[[ord(c) for c in _LETTERS[1:]]] = [1 + ["latin", "cyrillic", "greek", "armenian"].index(script_of(c)) for c in _LETTERS[1:]]


def _count_bigrams(text: str, total: np.ndarray, mixed: np.ndarray) -> None:
    """Add the bigrams of all words of one script to ``total``, and how many neighbouring
    letters are of one script and of two to ``mixed``."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 0x10000, code, 0)
    number, script = _NUMBER[code], _SCRIPT[code]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (number > 0).view(np.int8), [0]])))
    if not len(edge):
        return
    start, size = edge[::2], edge[1::2] - edge[::2]
    # The text behind a word is no letter, so its script (0) must not count as the least.
    low = np.minimum.reduceat(np.where(number > 0, script, 99), start)
    pure = low == np.maximum.reduceat(script, start)
    inside = np.zeros(len(code), bool)
    inside[np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(pure, size)
    before = np.concatenate([[0], number[:-1]])
    pair = (number[1:] > 0) & (number[:-1] > 0)
    other = int((script[1:] != script[:-1])[pair].sum())
    mixed += np.array([int(pair.sum()) - other, other])
    total += np.bincount(before[inside] * len(_LETTERS) + number[inside], minlength=len(total))


def bigrams(df: DataFrame, text: str) -> dict[tuple[str, str, str], float]:
    """Log probabilities of letter bigrams per script, counted over all texts in tokens
    of one script, and of a change of script (``switch``). The alphabets bound the result:
    it has at most the square of ``len(_LETTERS)`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mixed = np.zeros(len(_LETTERS) ** 2, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            held: list[str] = []
            size = 0
            for body in [*batch.column(0).to_pylist(), None]:
                if body is None or size > 2_000_000:
                    if held:
                        _count_bigrams("\n".join(held), total, mixed)
                    held, size = [], 0
                if body is not None:
                    held.append(body)
                    size += len(body)
        there = np.flatnonzero(total)
        first, second = there // len(_LETTERS), there % len(_LETTERS)
        columns = [[script_of(_LETTERS[i]) for i in second] + ["switch"] * 2, [_LETTERS[i] for i in first] + ["same", "other"], [_LETTERS[i] for i in second] + [""] * 2]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.string()) for c in columns), pa.array(np.concatenate([total[there], mixed]))], names=["script", "a", "b", "n"])

    counted = df.select(F.col(text).alias("text")).where("text is not null").mapInArrow(run, "script string, a string, b string, n bigint")
    rows = counted.groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()
    mixed = {r["a"]: r["n"] for r in rows if r["script"] == "switch"}
    rows = [r for r in rows if r["script"] != "switch"]
    totals: Counter = Counter()
    for r in rows:
        totals[r["script"], r["a"]] += r["n"]
    model = {(r["script"], r["a"], r["b"]): math.log(r["n"] / totals[r["script"], r["a"]]) for r in rows}
    same, other = mixed.get("same", 0), mixed.get("other", 0)
    return model | {("switch", "", ""): math.log((other + 1) / (same + other + 2))}


def consistent(df: DataFrame, text: str, out: str = "form", model: dict | None = None) -> DataFrame:
    """Add ``out``, the consistent form of the string column ``text``. Columns are kept;
    an existing ``out`` is replaced."""
    model = bigrams(df, text) if model is None else model

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forms = Forms(model)
        for batch in batches:
            yield batch.map(forms, na_action="ignore")

    return df.withColumn(out, form(F.col(f"`{text}`")))


def _keys(df: DataFrame, key: str, text: str, model: dict) -> DataFrame:
    """``id``, the 128-bit hash of the form and the 64-bit hash of the stored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(model)
        for batch in batches:
            hi, lo, stored = [], [], []
            for body in batch.column(1).to_pylist():
                drawn = forms(body).encode("utf-8", "surrogatepass")
                h = xxhash.xxh3_128_intdigest(drawn)
                hi.append((h >> 64) - (1 << 63))
                lo.append((h & (2**64 - 1)) - (1 << 63))
                stored.append(xxhash.xxh3_64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, type=pa.int64()) for x in (hi, lo, stored))], names=["id", "hi", "lo", "stored"])

    source = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, hi bigint, lo bigint, stored bigint")


def equal_looking(df: DataFrame, key: str, text: str, model: dict | None = None) -> DataFrame:
    """``id_a`` < ``id_b``: pairs of rows whose texts look the same though the stored
    characters differ. Pairs are made between classes of equal stored texts and then
    expanded, so pure copies cost nothing."""
    model = bigrams(df, text) if model is None else model
    rows = written(_keys(df, key, text, model), "forms")
    kinds = rows.groupBy("hi", "lo", "stored").agg(F.count("*").alias("n"))
    a = kinds.select("hi", "lo", F.col("stored").alias("sa"))
    b = kinds.select("hi", "lo", F.col("stored").alias("sb"))
    pairs = a.join(b, ["hi", "lo"]).where("sa < sb")
    x = rows.select("hi", "lo", F.col("stored").alias("sa"), F.col("id").alias("x"))
    y = rows.select("hi", "lo", F.col("stored").alias("sb"), F.col("id").alias("y"))
    out = pairs.join(x, ["hi", "lo", "sa"]).join(y, ["hi", "lo", "sb"]).where("x <> y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def classes(df: DataFrame, key: str, text: str, model: dict | None = None) -> DataFrame:
    """``id``, ``class_id`` (the smallest id of the rows with this form) and ``class_size``."""
    model = bigrams(df, text) if model is None else model
    rows = written(_keys(df, key, text, model).distinct(), "forms")
    # Counted before the join, so a form that a third of all rows share meets one row only.
    heads = rows.groupBy("hi", "lo").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(heads, ["hi", "lo"]).select("id", "class_id", "class_size")
