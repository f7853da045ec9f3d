"""Words typed in Latin letters in the native script: spellings that the letters can stand for, ranked by a vocabulary."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import ship

VIRAMA, NASALS = "्", ("ं", "ँ")

# The spellings of each group of Latin letters, the likeliest first; of vowels the letter on its own and the sign behind a consonant.
CONSONANTS = {
    "chh": ["छ"], "ksh": ["क्ष"], "ck": ["क"], "gy": ["ज्ञ", "ग्य"], "kh": ["ख"], "gh": ["घ"], "ch": ["च", "छ"], "jh": ["झ"],
    "th": ["थ", "ठ"], "dh": ["ध", "ढ"], "ph": ["फ"], "bh": ["भ"], "sh": ["श", "ष"], "rh": ["ढ़"],
    "k": ["क"], "g": ["ग"], "c": ["च", "क"], "j": ["ज"], "z": ["ज़", "ज"], "t": ["त", "ट"], "d": ["द", "ड", "ड़"],
    "n": ["न", "ण"], "p": ["प"], "f": ["फ़", "फ"], "b": ["ब"], "m": ["म"], "y": ["य"], "r": ["र"], "l": ["ल"],
    "v": ["व"], "w": ["व"], "s": ["स", "श", "ष"], "h": ["ह"], "q": ["क़", "क"], "x": ["क्ष", "क्स"],
}
ASSAMESE_CONSONANTS = {
    "x": ["स", "श", "ष", "क्ष", "ख"], "s": ["स", "श", "ष", "छ", "च"], "ch": ["च", "छ"], "z": ["ज", "य"], "j": ["ज", "य"],
    "y": ["य़", "य"], "v": ["भ", "व"], "f": ["फ"], "q": ["क"], "rh": ["ढ़", "ड़"],
}
VOWELS = {
    "aa": [("आ", "ा")], "ai": [("ऐ", "ै"), ("अई", "ई")], "au": [("औ", "ौ"), ("अउ", "उ")], "ee": [("ई", "ी")], "ii": [("ई", "ी")],
    "oo": [("ऊ", "ू"), ("ओ", "ो")], "uu": [("ऊ", "ू")], "ei": [("ए", "े")], "ou": [("औ", "ौ"), ("ओ", "ो")], "a": [("अ", ""), ("आ", "ा")],
    "i": [("इ", "ि"), ("ई", "ी")], "u": [("उ", "ु"), ("ऊ", "ू")], "e": [("ए", "े")], "o": [("ओ", "ो")], "ri": [("रि", "्रि"), ("री", "्री"), ("ऋ", "ृ")],
}
ASSAMESE_VOWELS = {"o": [("ओ", "ो"), ("अ", "")], "oi": [("अइ", "इ"), ("ऐ", "ै"), ("ओई", "ोई")]}
#: Letters of Assamese that are not 0x80 behind the Devanagari ones, spellings tried at most, the spellings of a last "a", and what the second of them costs.
OWN_LETTERS = {"र": "ৰ", "व": "ৱ"}
MOST, LAST_A, LAST_A_COST = 12_000, [("आ", "ा"), ("अ", "")], 0.5


#: A step takes what stands between a consonant without its vowel and a next consonant (None behind anything else) to the letters that it adds and the same behind them.
Step = Callable[[str | None], tuple[str, str | None]]


def _vowel(letter: str, sign: str) -> Step:
    return lambda joint: (letter if joint is None else sign, None)


def _consonant(letter: str) -> Step:
    return lambda joint: ((joint or "") + letter, VIRAMA)


def _nasal(sign: str) -> Step:
    return lambda joint: (sign, None)


def _between(chosen: str) -> Step:
    return lambda joint: ("", None if joint is None else chosen)


class Speller:
    """The spellings of Latin words in one language. pieces: text to the kinds and scores of its tokens, as (is a byte, score).

    A word is a lattice: a column for each group of letters, and one between two consonants, whose edges are spellings. Its paths are laid out column by column, all beginnings of a length at a time, so that what paths
    share is spelt once.
    """

    def __init__(self, language: str, pieces: Callable[[str], list[tuple[bool, float]]]) -> None:
        assamese = language == "assamese"
        self.consonants = CONSONANTS | (ASSAMESE_CONSONANTS if assamese else {})
        self.vowels = VOWELS | (ASSAMESE_VOWELS if assamese else {})
        self.groups = re.compile("|".join(sorted([*self.consonants, *self.vowels], key=len, reverse=True)))
        self.letters = {c: c + 0x80 for c in range(0x900, 0x980)} | {ord(a): b for a, b in OWN_LETTERS.items()} if assamese else {}
        self.pieces = pieces

    def lattice(self, word: str) -> list[list[tuple[Step, float]]]:
        """The columns of a word: steps and their costs, the likeliest first; letters without a reading have none."""
        groups = self.groups.findall(word)
        columns: list[list[tuple[Step, float]]] = []
        for before, key, after in zip([None, *groups], groups, [*groups[1:], None], strict=False):
            if key in self.vowels:
                last = key == "a" and before is not None and after is None
                columns.append([(_vowel(*spelt), i * LAST_A_COST if last else 0.0) for i, spelt in enumerate(LAST_A if last else self.vowels[key])])
                continue
            if before is not None and before not in self.vowels:
                columns.append([(_between(VIRAMA), 0.0), (_between(""), 0.0)])  # the consonants are joined, or the first keeps its vowel
            ends_syllable = before is not None and (after is None or after not in self.vowels)
            signs = NASALS[: {"n": 2, "m": 1}.get(key, 0)] if ends_syllable else ()
            columns.append([(_consonant(c), 0.0) for c in self.consonants[key]] + [(_nasal(c), 0.0) for c in signs])
        return columns

    def spellings(self, columns: list[list[tuple[Step, float]]]) -> dict[str, tuple[float, int]]:
        """Each text that a path spells, with the cost and the number of unlikely steps of the first such path, in the order of the paths."""
        paths: list[tuple[str, str | None, float, int]] = [("", None, 0.0, 0)]
        for column in columns:
            longer = []
            for text, joint, cost, unlikely in paths:
                for i, (step, more) in enumerate(column):
                    added, left = step(joint)
                    longer.append((text + added, left, cost + more, unlikely + i))
            paths = longer
        found: dict[str, tuple[float, int]] = {}
        for text, _, cost, unlikely in paths:
            found.setdefault(text.translate(self.letters), (cost, unlikely))
        return found

    def suggest(self, word: str, k: int = 5) -> list[str]:
        """Up to k spellings: those with the fewest pieces (a byte counts as three), then the most frequent pieces, then the likeliest letters."""
        columns = self.lattice(word.lower())
        if not columns:
            return []
        while math.prod(map(len, columns)) > MOST:  # the last of the columns with the most spellings loses its least likely one
            max(reversed(columns), key=len).pop()

        def rank(found: tuple[str, tuple[float, int]]) -> tuple[float, float, int]:
            text, (cost, unlikely) = found
            tokens = self.pieces(text)
            return sum(3 if byte else 1 for byte, _ in tokens) + cost, -sum(score for byte, score in tokens if not byte), unlikely

        return [text for text, _ in heapq.nsmallest(k, self.spellings(columns).items(), key=rank)]


def speller(language: str, vocabulary: DataFrame, **places: int) -> Speller:
    """A speller by a vocabulary table (piece, id, score), which is small."""
    from corpuslab.operators.tokens import bpe_of

    bpe = bpe_of(vocabulary, **places)
    scores = {r["id"]: float(r["score"]) for r in vocabulary.select("id", "score").collect()}
    return Speller(language, lambda text: [(bpe.kind(i) == "bytes", scores.get(i, 0.0)) for i in bpe.encode(text)])


def suggestions(words: DataFrame, spell: Speller, k: int = 5, word: str = "word") -> DataFrame:
    """words with suggestions (array<string>): up to k spellings, the best first. Distinct words should be given: each is tried in thousands of spellings."""
    ship(words.sparkSession)

    @F.pandas_udf("array<string>")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda w: None if w is None else spell.suggest(w, k))

    return words.withColumn("suggestions", run(F.col(word)))


#: Words whose best spelling a worker remembers at a time.
REMEMBERED = 100_000


def transliterated(docs: DataFrame, spell: Speller, text: str = "text") -> DataFrame:
    """docs with native: each run of Latin letters replaced by its best spelling, or left where it has none."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def best(m: re.Match) -> str:
            word = m[0]
            if word not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = (spell.suggest(word, 1) or [word])[0]
            return known[word]

        for s in rows:
            yield s.map(lambda t: None if t is None else re.sub("[A-Za-z]+", best, t))

    return docs.withColumn("native", run(F.col(text)))


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
