"""Token sequences: windows, pairs, masks, batches, vocabularies and the numbers that compare tokenizers."""

from __future__ import annotations

import gc
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.session import in_arrow, ship

#: Ids of the special tokens, of the first byte and of the first merge in a vocabulary file.
PAD, UNK, BOS, EOS, FIRST_BYTE, FIRST_MERGE = 0, 1, 2, 3, 4, 260


def windows(ids: Column, size: int, starts: Column) -> Column:
    """Runs of `size` ids from the given places (from 0) that fit."""
    return F.transform(F.filter(starts, lambda s: s + size <= F.size(ids)), lambda s: F.slice(ids, s + 1, size))


def prefixes(ids: Column, starts: Column, prefix: int = 32, target: int = 64) -> Column:
    """(prefix, target) structs of the windows at the given places."""
    return F.transform(windows(ids, prefix + target, starts), lambda w: F.struct(F.slice(w, 1, prefix).alias("prefix"), F.slice(w, prefix + 1, target).alias("target")))


def block_starts(n_tokens: Column, block: int, wanted: int) -> Column:
    """Places of at most `wanted` blocks spread evenly over those that fit, none overlapping."""
    fit = F.floor(n_tokens / block).cast("int")  # a number; callers give the size of an array, not the array
    n = F.least(fit, F.lit(wanted))
    place = lambda i: F.when(n <= 1, F.lit(0)).otherwise(F.floor(i * ((fit - 1) / (n - 1).cast("double")) + 1e-9).cast("int")) * block
    return F.when(fit < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), place))


def next_pairs(ids: Column) -> Column:
    """struct<x, y>: the sequence and itself one further on."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), n).alias("x"), F.slice(ids, F.lit(2), n).alias("y"))


def with_end(ids: Column, end: int = EOS) -> Column:
    return F.concat(ids, F.array(F.lit(end)))


def masked(df: DataFrame, prompt: str, answer: str, block: int = 128, end: int = EOS) -> DataFrame:
    """df with x, y (arrays of `block` ids) and n_real: prompt and answer with its end, the prompt cut to leave room and not a target (-100). Rows without a target go."""
    a = with_end(F.col(answer), end)
    p = F.slice(F.col(prompt), F.lit(1), F.greatest(F.lit(1), F.lit(block) - F.size(a)))
    ids = F.slice(F.concat(p, a), 1, block + 1)
    made = df.where(F.size(answer) > 0).withColumn("_ids", ids).withColumn("_p", F.least(F.size(p), F.lit(block + 1))).where(F.size("_ids") >= 2)
    labels = F.concat(F.array_repeat(F.lit(-100), F.col("_p")), F.slice("_ids", F.col("_p") + 1, F.greatest(F.size("_ids") - F.col("_p"), F.lit(0))))
    made = made.withColumn("_y", labels).withColumn("n_real", F.size("_ids") - 1)

    def padded(c: str, by: int) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(by), F.lit(block + 1) - F.size(c)))

    out = made.withColumn("x", F.slice(padded("_ids", PAD), 1, block)).withColumn("y", F.slice(padded("_y", -100), 2, block))
    return out.where(F.exists("y", lambda v: v != -100)).drop("_ids", "_p", "_y")


def sft_line(text: Column, answer: Column) -> Column:
    """Text and answer in a row, for encoding; cut the ids with slice(ids, 1, limit)."""
    return T.strip(F.concat_ws(" ", text, answer))


def batches(df: DataFrame, length: Column, order: list[Column], size: int = 32) -> DataFrame:
    """df with length and batch: rows of one length in batches of `size`, in the given order, which should tell rows apart."""
    from corpuslab.operators.select import ranked

    rows = ranked(df.withColumn("length", length), order, "_rank", ["length"])
    return rows.withColumn("batch", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def word_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, id): distinct words in order, numbered from 0 by a distributed rank."""
    from corpuslab.operators.select import ranked

    found = docs.select(F.explode(T.words(F.col(text))).alias("word")).distinct()
    return ranked(found, [F.col("word")], "id")


# ---------------------------------------------------------------- vocabularies


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score, type) of a file of piece<TAB>id lines; type: 1 plain, 2 unknown, 3 control, 6 byte."""
    lines = spark.read.text(path).where("value <> ''")
    parts = F.split("value", "\t")
    piece, i = parts[0], parts[1].cast("int")
    kind = F.when(i == UNK, 2).when(i.isin(PAD, BOS, EOS), 3).when(piece.rlike("^<0x[0-9A-F]{2}>$"), 6).otherwise(1)
    return lines.select(piece.alias("piece"), i.alias("id"), F.when(i >= FIRST_MERGE, (FIRST_MERGE - i).cast("double")).otherwise(0.0).alias("score"), kind.alias("type"))


#: Special tokens of reasoning, whose ids follow those of the vocabulary.
SPECIALS = ("<COT_START>", "<COT_END>", "<REL_GT>", "<REL_LT>", "<REL_EQ>", "<REL_DISJOINT>")
#: Words of which something is remembered, in each half of a memory. Symbols from which on a word's merges are kept in a heap.
REMEMBERED, LONG = 100_000, 64
#: Bytes of texts, and ids, that are worked on at a time: Python's own lists of them take many times as much.
TEXT_BYTES, IDS = 4 << 20, 1 << 16
#: The type of a plain piece, and how far below the least score an unknown character lies.
PLAIN, UNKNOWN_COST = 1, 10.0


def _words(text: str) -> list[str]:
    """What stands between the spaces of a text in NFKC."""
    return [w for w in unicodedata.normalize("NFKC", text).split(" ") if w]


class Remembered:
    """What was made of words, in two halves: when the younger is full the older goes, and what is asked for stays young."""

    def __init__(self) -> None:
        self.young, self.old = {}, {}

    def of(self, words: Iterable[str], make: Callable[[list[str]], dict]) -> dict:
        """By word, for all the words at least."""
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for w in set(words).difference(young):
            found = old.get(w)
            if found is None:
                new.append(w)
            else:
                young[w] = found
        if new:
            young.update(make(new))
        return young


class RankedBpe:
    """BPE by ids: of neighbouring pieces whose union is a piece, the one with the least id is merged first, the leftmost of several; bytes stand for unknown characters.

    first_byte, first_merge: where a vocabulary has its bytes and its merges. special: strings that are ids of their own.
    """

    def __init__(self, vocabulary: dict[str, int], special: dict[str, int] | None = None, first_byte: int = FIRST_BYTE, first_merge: int = FIRST_MERGE) -> None:
        self.ids, self.special, self.first_byte, self.first_merge = vocabulary, special or {}, first_byte, first_merge
        self.pieces = {i: p for p, i in vocabulary.items()} | {i: p for p, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known, self.seen = Remembered(), Remembered()

    @cached_property
    def merges(self) -> dict[str, int]:
        """Ranks of what two neighbours can become."""
        return {p: i for p, i in self.ids.items() if i >= self.first_merge}

    def parts(self, word: str) -> list[str]:
        """The pieces of a word; a character that is no piece stands for itself. After a merge only the pairs beside it are looked up."""
        if len(word) >= LONG:
            return self._parts_of_long(word)
        get, none = self.merges.get, float("inf")
        parts = list(word)
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            merged = parts[i] + parts[i + 1]
            parts[i : i + 2] = [merged]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + merged, none)
            if i < len(ranks):
                ranks[i] = get(merged + parts[i + 1], none)
        return parts

    def _parts_of_long(self, word: str) -> list[str]:
        """The same, with the pairs in a heap by rank and place: a part stands at its first character, and a pair that has changed since is passed over."""
        get = self.merges.get
        parts: list[str] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (rank := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != merged:
                continue
            parts[i], parts[j] = merged, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get(merged + parts[k])) is not None:
                    heapq.heappush(heap, (rank, i, merged + parts[k]))
            h = before[i]
            if h >= 0 and (rank := get(parts[h] + merged)) is not None:
                heapq.heappush(heap, (rank, h, parts[h] + merged))
        return [p for p in parts if p]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of distinct words."""
        ids, first, out = self.ids, self.first_byte, {}
        for word in words:
            mine = out[word] = []
            for p in self.parts(word):
                i = ids.get(p)
                if i is None:
                    mine += [first + b for b in p.encode("utf-8", "replace")]
                else:
                    mine.append(i)
        return out

    def word(self, word: str) -> list[int]:
        return self.known.of([word], self.encode_words)[word]

    def encode(self, text: str) -> list[int]:
        """In NFKC, runs of spaces are one and those at the ends go; a space is put before the text. Other white space stays, as bytes where it is no piece."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; what the texts have in words is looked up together."""
        split = [[part if part in self.special else ["▁" + w for w in _words(part)] for part in (self.split.split(text) if self.split else [text])] for text in texts]
        known = self.known.of([w for parts in split for part in parts if isinstance(part, list) for w in part], self.encode_words)
        return [[i for part in parts for i in ([self.special[part]] if isinstance(part, str) else chain.from_iterable([known[w] for w in part]))] for parts in split]

    @cached_property
    def faces(self) -> dict[int, tuple[str, str, int, bool]]:
        """Of each id that is no byte: its text when decoded, its text among the segments (none if unknown), whether a word begins, whether it is unknown."""
        out = {}
        for i, piece in self.pieces.items():
            if not self.first_byte <= i < self.first_byte + 256:
                ((kind, text, starts, _),) = self.segments([i])
                out[i] = (piece.replace("▁", " ") if i >= self.first_byte else "", self._shown(kind, text, starts), int(piece.startswith("▁")), kind == "unknown")
        return out

    @staticmethod
    def _shown(kind: str, text: str, starts: bool) -> str:
        return "" if kind == "unknown" else " " + text if starts and text != " " else text

    def _see(self, words: list[str]) -> dict[str, tuple[str, str, int, bool]]:
        """By word, what its pieces are together, as in faces. A word's bytes make up whole characters, so that words can be read one by one."""
        faces, none, out = self.faces, ("", "", 0, True), {}
        for word, ids in self.encode_words(["▁" + w for w in words]).items():
            mine = [faces.get(i, none) for i in ids]
            first = self.first_byte
            if any(first <= i < first + 256 for i in ids):
                segments = self.segments(ids)
                decoded, held = "", bytearray()
                for i, face in zip([*ids, -1], [*mine, none], strict=True):
                    if first <= i < first + 256:
                        held.append(i - first)
                        continue
                    if held:
                        decoded += held.decode("utf-8", "replace").replace("▁", " ")
                        held = bytearray()
                    decoded += face[0]
                face = (decoded, "".join([self._shown(*s[:3]) for s in segments]), sum([f[2] for f in mine]), any(s[0] == "unknown" for s in segments))
            else:
                face = ("".join([f[0] for f in mine]), "".join([f[1] for f in mine]), sum([f[2] for f in mine]), any([f[3] for f in mine]))
            out[word[1:]] = face
        return out

    def see(self, texts: list[str]) -> list[tuple[str, str, int, bool]]:
        """Of each text its decoded ids, its segments' texts in a row, with a space before those that begin a word and none for unknown ones, how many pieces begin a word, and whether any is unknown."""
        if self.special:
            raise ValueError("texts with special tokens are shown by segments()")
        split = [_words(text) for text in texts]
        known = self.seen.of(chain.from_iterable(split), self._see)
        decoded, shown, begins, unknown = (itemgetter(k) for k in range(4))
        out = []
        for words in split:
            mine = [known[w] for w in words]
            out.append(("".join(map(decoded, mine)).removeprefix(" "), "".join(map(shown, mine)), sum(map(begins, mine)), any(map(unknown, mine))))
        return out

    def kind(self, i: int) -> str:
        piece = self.pieces.get(i)
        if self.first_byte <= i < self.first_byte + 256:
            return "bytes"
        return "unknown" if piece is None or piece == "<unk>" else "control" if i < self.first_byte or i in self.special.values() else "piece"

    def decode(self, ids: list[int]) -> str:
        """Runs of bytes are read together; control tokens go, special ones stay; the space before the text, and before what follows a special token, goes."""
        out, now, held = [], "", bytearray()
        for i in [*ids, -1]:
            if self.first_byte <= i < self.first_byte + 256:
                held.append(i - self.first_byte)
                continue
            if held:
                now += held.decode("utf-8", "replace")
                held = bytearray()
            piece = self.pieces.get(i, "")
            if i == -1 or piece in self.special:
                out += [now.replace("▁", " ").removeprefix(" "), piece]
                now = ""
            elif i >= self.first_byte:
                now += piece
        return "".join(out)

    def segments(self, ids: list[int]) -> list[tuple[str, str, bool, list[int]]]:
        """(kind, text, whether a word starts, ids) as a reader sees them: bytes that make up a character are one segment."""
        out: list[tuple[str, str, bool, list[int]]] = []
        for i in ids:
            kind, piece = self.kind(i), self.pieces.get(i, "<unk>")
            if kind == "bytes":
                last = out[-1] if out and out[-1][0] == "bytes" and "\ufffd" in out[-1][1] else None
                run = [*last[3], i] if last else [i]
                if last:
                    out.pop()
                out.append((kind, bytes(b - self.first_byte for b in run).decode("utf-8", "replace"), False, run))
            else:
                out.append((kind, piece.replace("▁", " ").lstrip() or " ", piece.startswith("▁"), [i]))
        return out


class Unigram(RankedBpe):
    """The segmentation whose pieces' scores have the largest sum, by Viterbi's recursion over each word; of several the one whose last piece is longest, and so on to the front.

    scores: of the pieces that may be used. A character that is no piece costs UNKNOWN_COST below the least score; it becomes its bytes, or, where the vocabulary has none (first_byte is None), an unknown id for each
    run of such characters. Texts are read, decoded and shown as in RankedBpe.
    """

    def __init__(self, vocabulary: dict[str, int], scores: dict[str, float], special: dict[str, int] | None = None, first_byte: int | None = FIRST_BYTE, unknown: int = UNK) -> None:
        super().__init__(vocabulary, special, len(vocabulary) if first_byte is None else first_byte, 0)
        self.scores, self.unknown, self.bytes = scores, unknown, first_byte is not None
        self.least = min(scores.values(), default=0.0) - UNKNOWN_COST

    @cached_property
    def beginnings(self) -> set[str]:
        """What pieces begin with, whole ones included."""
        return {p[:n] for p in self.scores for n in range(1, len(p) + 1)}

    @cached_property
    def ends(self) -> dict[str, tuple[str, tuple[tuple[int, float], ...]]]:
        """By the tail of a prefix (its longest end that a piece begins with) and the character behind it: the tail then, and the lengths and scores of what can end there, the longest first."""
        return {}

    def _grown(self, grown: str) -> tuple[str, tuple[tuple[int, float], ...]]:
        tail, scores = grown, self.scores
        while tail and tail not in self.beginnings:
            tail = tail[1:]
        found = [(len(tail) - i, scores[tail[i:]]) for i in range(len(tail)) if tail[i:] in scores]
        if not found or found[-1][0] > 1:
            found.append((1, self.least))
        if len(self.ends) >= REMEMBERED:
            self.ends.clear()
        out = self.ends[grown] = (tail, tuple(found))
        return out

    def paths(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Distinct words, in order, with the pieces of their best paths; a character that is no piece stands for itself. What is best up to a character depends on what is before it alone: a word takes over from the one
        before it in the order what they begin with."""
        ends, grow = self.ends, self._grown
        total, size, tails, before = [0.0], [0], [""], ""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del total[shared + 1 :], size[shared + 1 :], tails[shared + 1 :]
            tail = tails[shared]
            for at in range(shared + 1, n + 1):
                grown = tail + word[at - 1]
                tail, found = ends.get(grown) or grow(grown)
                best, chosen = float("-inf"), 1
                for k, score in found:
                    score += total[at - k]
                    if score > best:
                        best, chosen = score, k
                total.append(best)
                size.append(chosen)
                tails.append(tail)
            out = []
            while n:
                k = size[n]
                out.append(word[n - k : n])
                n -= k
            out.reverse()
            before = word
            yield word, out

    def best(self, word: str) -> list[str]:
        """The pieces of the best path of one word."""
        ((_, out),) = self.paths([word])
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for word, pieces in self.paths(words):
            mine = out[word] = []
            fused = False
            for piece in pieces:
                known = piece in self.scores
                if known:
                    mine.append(self.ids[piece])
                elif self.bytes:
                    mine += [self.first_byte + b for b in piece.encode("utf-8", "replace")]
                elif not fused:
                    mine.append(self.unknown)
                fused = not known
        return out


def unigram_of(vocabulary: DataFrame, special: dict[str, int] | None = None, first_byte: int | None = FIRST_BYTE, unknown: int = UNK, size: int | None = None) -> Unigram:
    """The unigram model of a vocabulary table (piece, id, score, type), which is small; `size`: its first ids alone."""
    ship(vocabulary.sparkSession)
    rows = (vocabulary if size is None else vocabulary.where(F.col("id") < size)).select("piece", "id", "score", "type").collect()
    return Unigram({r["piece"]: r["id"] for r in rows}, {r["piece"]: float(r["score"]) for r in rows if r["type"] == PLAIN}, special, first_byte, unknown)


def model_vocabulary(spark, path: str) -> DataFrame:
    """(piece, id, score, type) of a SentencePiece model file, of whatever kind; type: 1 plain, 2 unknown, 3 control, 6 byte. The file is opened where the driver runs."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 6 if m.is_byte(i) else 3 if m.is_control(i) else 2 if m.is_unknown(i) else PLAIN
    return spark.createDataFrame([(m.id_to_piece(i), i, float(m.get_score(i)), kind(i)) for i in range(m.get_piece_size())], "piece string, id int, score double, type int")


_IDS = pa.list_(pa.int32())


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in turn, TEXT_BYTES or IDS of a column of texts or of lists at a time, and a row at least."""
    values = batch.column(column)
    listed = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    ends = np.cumsum(pc.fill_null((pc.list_value_length if listed else pc.binary_length)(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (IDS if listed else TEXT_BYTES), side="right")))
        yield batch.slice(at, end - at)
        at = end


def _made(df: DataFrame, column: str, fields: dict[str, str], make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """df with columns of given types, made of the values of one that are not null, some at a time; where that is null they are null."""
    wanted = df.limit(0).withColumns({name: F.lit(None).cast(kind) for name, kind in fields.items()}).schema
    own, places = [c.lower() for c in df.columns], {name.lower(): k for k, name in enumerate(fields)}
    source = own.index(column.lower())
    takes = [(places[f.name.lower()], True) if f.name.lower() in places else (k, False) for k, f in enumerate(wanted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of strings and tuples, and no cycles among them
        try:
            for batch in batches:
                for part in _slices(batch, source):
                    values = part.column(source)
                    there = pc.is_valid(values)
                    made = make(values.filter(there).to_pylist())
                    # where there is no value, the place of none is taken
                    spots = pc.if_else(there, pc.subtract(pc.cumulative_sum(there.cast(pa.int64())), 1), pa.scalar(None, pa.int64()))
                    made = [m.take(spots) for m in made] if values.null_count else made
                    yield pa.RecordBatch.from_arrays([made[k] if new else part.column(k) for k, new in takes], wanted.names)
        finally:
            gc.enable()

    return in_arrow(df, run, wanted)


def shown(docs: DataFrame, tokenizer: RankedBpe, text: str = "text") -> DataFrame:
    """docs with decoded, shown, begins and unknown by a tokenizer without special tokens: its decoded ids, its segments as a reader sees them in a row (those that are not unknown), the pieces that begin a word, and
    whether any is unknown. What a word is like is found once for all texts at hand. Null texts have none of them."""

    def make(texts: list[str]) -> list[pa.Array]:
        columns = list(zip(*tokenizer.see(texts), strict=True)) or [()] * 4
        return [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)]

    return _made(docs, text, {"decoded": "string", "shown": "string", "begins": "long", "unknown": "boolean"}, make)


def measured(docs: DataFrame, tokenizer: RankedBpe, text: str = "text") -> DataFrame:
    """docs with ids, n_tokens, n_unknown and decoded by a tokenizer, ready for tokenizer_scores(). Null texts have none of them."""
    unknown = tokenizer.unknown if isinstance(tokenizer, Unigram) else UNK

    def make(texts: list[str]) -> list[pa.Array]:
        ids = tokenizer.encode_all(texts)
        return [pa.array(ids, _IDS), pa.array([tokenizer.decode(i) for i in ids], pa.string())]

    coded = _made(docs, text, {"ids": "array<int>", "decoded": "string"}, make)
    return coded.withColumns({"n_tokens": F.size("ids"), "n_unknown": F.size(F.filter("ids", lambda i: i == unknown))})


def bpe_of(vocabulary: DataFrame, special: dict[str, int] | None = None, **places: int) -> RankedBpe:
    """The BPE of a vocabulary table (piece, id), which is small: some ten thousand rows."""
    ship(vocabulary.sparkSession)
    return RankedBpe({r["piece"]: r["id"] for r in vocabulary.select("piece", "id").collect()}, special, **places)


def special_ids(size: int) -> dict[str, int]:
    """The special tokens behind a vocabulary of so many pieces; with them it has len(SPECIALS) more."""
    return {t: size + i for i, t in enumerate(SPECIALS)}


def encoded(docs: DataFrame, vocabulary: DataFrame, text: str = "text", special: dict[str, int] | None = None, **places: int) -> DataFrame:
    """docs with ids by a vocabulary."""
    bpe = bpe_of(vocabulary, special, **places)
    return _made(docs, text, {"ids": "array<int>"}, lambda texts: [pa.array(bpe.encode_all(texts), _IDS)])


def decoded(df: DataFrame, vocabulary: DataFrame, special: dict[str, int] | None = None, **places: int) -> DataFrame:
    bpe = bpe_of(vocabulary, special, **places)
    return _made(df, "ids", {"decoded": "string"}, lambda rows: [pa.array([bpe.decode(ids) for ids in rows], pa.string())])


def with_pieces(df: DataFrame, vocabulary: DataFrame, special: dict[str, int] | None = None, **places: int) -> DataFrame:
    """df (ids) with pieces (array<string>) and segments (kind, text, starts, ids)."""
    bpe = bpe_of(vocabulary, special, **places)

    def make(rows: list[list[int]]) -> list[pa.Array]:
        found = [bpe.segments(ids) for ids in rows]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * 4
        names = ("kind", "text", "starts", "ids")
        parts = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.bool_(), _IDS), strict=True)], names)
        return [pa.array([[bpe.pieces.get(i, "<unk>") for i in ids] for ids in rows], pa.list_(pa.string())), pa.ListArray.from_arrays(ends, parts)]

    return _made(df, "ids", {"pieces": "array<string>", "segments": "array<struct<kind: string, text: string, starts: boolean, ids: array<int>>>"}, make)


def vocabulary_json(vocabulary: DataFrame, unknown: int = UNK, end: int = EOS) -> DataFrame:
    """One row, json: pieces [piece, score to six places, type] in the order of ids, unk_id and eos_id. A vocabulary is small enough for one row."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", "piece", F.round("score", 6).alias("score"), "type"))), lambda r: F.concat(F.lit("["), F.regexp_replace(F.to_json(F.struct(r["piece"].alias("p"))), r'^\{"p":|\}$', ""), F.lit(","), r["score"].cast("string"), F.lit(","), r["type"].cast("string"), F.lit("]")))
    return vocabulary.agg(F.concat(F.lit('{"pieces":['), F.array_join(rows, ","), F.lit(f'],"unk_id":{unknown},"eos_id":{end}}}')).alias("json"))


def joined_ids(docs: DataFrame, order: str, end: int = EOS, within: list[str] | None = None) -> DataFrame:
    """A row, ids, for each batch of docs (order, ids): those of its documents in a row, an end behind each. within: columns that name the batches; without them all is one. A batch is small; whole corpora go to sinks.write_tokens()."""
    rows = F.collect_list(F.struct(order, with_end(F.col("ids"), end).alias("ids")))
    return docs.groupBy(*(within or [])).agg(F.flatten(F.transform(F.array_sort(rows), lambda r: r["ids"])).alias("ids"))


def split_encoded(docs: DataFrame, vocabulary: DataFrame, names: Column, text: str = "text") -> DataFrame:
    """docs with ids in which a name has the ids that it has alone, wherever it stands: a suffix of up to three letters behind it is encoded as a piece within a word."""
    bpe = bpe_of(vocabulary)

    def ids(words: list[tuple[str, str]]) -> list[int]:
        out = []
        for name, rest in words:
            out += bpe.word("▁" + name)
            out += bpe.word(rest) if rest else []
        return out

    @F.pandas_udf("array<int>")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda x: None if x is None else ids([(w["name"], w["rest"]) for w in x]))

    return docs.withColumn("ids", run(F.transform(T.words(F.col(text)), lambda w: name_and_rest(w, names))))


def random_starts(n_tokens: Column, span: Column, wanted: int, key: Column, seed: int) -> Column:
    """Up to `wanted` different places, in order, of windows of `span` ids that fit: a uniform sample without replacement (Floyd's), drawn by hashes of seed, key and place; all places where there are no more."""
    fit = F.greatest(n_tokens - span + 1, F.lit(0))
    n = F.least(fit, F.lit(wanted))
    none = F.array().cast("array<int>")

    def drawn(chosen: Column, last: Column) -> Column:
        place = F.pmod(F.xxhash64(F.lit(seed), key, last), last + 1).cast("int")
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, place), last).otherwise(place)))

    return F.when(n < 1, none).otherwise(F.array_sort(F.aggregate(F.sequence(fit - n, F.greatest(fit, F.lit(1)) - 1).cast("array<int>"), none, drawn)))


def random_windows(docs: DataFrame, block: int, wanted: int, seed: int) -> DataFrame:
    """(doc_id, start, x, y): windows at random places of docs (doc_id, ids), each with the window one id further on."""
    starts = random_starts(F.size("ids"), F.lit(block + 1), wanted, F.col("doc_id"), seed)
    return docs.select("doc_id", "ids", F.explode(starts).alias("start")).select("doc_id", "start", F.slice("ids", F.col("start") + 1, F.lit(block)).alias("x"), F.slice("ids", F.col("start") + 2, F.lit(block)).alias("y"))


def sft_ids(examples: DataFrame, vocabulary: DataFrame, use_rationale: bool = True, most: int = 256) -> DataFrame:
    """examples (id, text, answer_text, cot_text) to (id, ids): text and answer (with its rationale, if asked and there) in a row, cut at `most` ids. sinks.write_tokens(end=None) makes a file of them."""
    said = F.coalesce(F.col("cot_text") if use_rationale and "cot_text" in examples.columns else F.lit(None), F.col("answer_text"), F.lit(""))
    rows = encoded(examples.select("id", sft_line(F.col("text"), said).alias("_line")), vocabulary, "_line")
    return rows.select("id", F.slice("ids", 1, most).alias("ids"))


def pair_counts(words: DataFrame, top: int) -> DataFrame:
    """(left, right, count): the most frequent neighbouring symbols of words (symbols array<string>, count), ties in their own order."""
    n = F.size("symbols")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.get("symbols", i - 1).alias("left"), F.get("symbols", i).alias("right")))
    out = words.where(n > 1).select(F.explode(pairs).alias("p"), "count").groupBy("p.left", "p.right").agg(F.sum("count").alias("count"))
    return out.orderBy(F.desc("count"), "left", "right").limit(top)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(T.words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


# ---------------------------------------------------------------- comparing tokenizers


def tokenizer_scores(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Of rows (text, n_tokens, n_unknown, decoded): tokens for each word (a line has one at least), unknown share, characters and bytes for each token, share of exact round trips."""
    words = F.greatest(F.lit(1), T.word_count(F.col("text")))
    tokens = F.nullif(F.sum("n_tokens"), F.lit(0))
    return rows.groupBy(*(group or [])).agg(
        F.round(F.sum("n_tokens") / F.sum(words), 4).alias("fertility"),
        F.round(F.sum("n_unknown") / tokens, 6).alias("unk_rate"),
        F.round(F.sum(F.char_length("text")) / tokens, 4).alias("chars_per_token"),
        F.round(F.sum(F.octet_length("text")) / tokens, 4).alias("bytes_per_token"),
        F.round(F.avg((F.col("decoded") == F.col("text")).cast("int")), 4).alias("roundtrip"),
    )


def decide_size(candidates: DataFrame, model_type: str, small: int = 16384, large: int = 32768, most_ratio: float = 1.15, most_unknown: float = 1e-4) -> DataFrame:
    """One row, vocab_size: the small one if its fertility is within the ratio of the large one's and neither leaves more unknown than allowed."""
    own = candidates.where(F.col("model_type") == model_type)
    one = own.agg(*(F.max(F.when(F.col("vocab_size") == v, F.col(c))).alias(f"{c}_{n}") for n, v in (("small", small), ("large", large)) for c in ("fertility", "unk_rate")))
    fits = (F.col("fertility_small") / F.col("fertility_large") <= most_ratio) & (F.col("unk_rate_small") <= most_unknown) & (F.col("unk_rate_large") <= most_unknown)
    return one.select(F.lit(model_type).alias("model_type"), F.when(fits, small).otherwise(large).alias("vocab_size"), F.round(F.col("fertility_small") / F.col("fertility_large"), 4).alias("ratio"))


# ---------------------------------------------------------------- names


def name_and_rest(word: Column, names: Column, longest_suffix: int = 3) -> Column:
    """struct<name, rest>: the longest name that a word starts with and a suffix of up to three letters; any other word is all name."""
    fits = F.filter(names, lambda n: word.startswith(n) & (F.char_length(word) > F.char_length(n)) & (F.char_length(word) - F.char_length(n) <= longest_suffix))
    best = F.array_max(F.transform(fits, lambda n: F.struct(F.char_length(n).alias("k"), n.alias("n"))))
    whole = F.array_contains(names, word) | best.isNull()
    return F.struct(F.when(whole, word).otherwise(best["n"]).alias("name"), F.when(whole, F.lit("")).otherwise(F.substring(word, best["k"] + 1, F.char_length(word))).alias("rest"))


def name_split(text: Column, names: Column, longest_suffix: int = 3) -> Column:
    """Words of a text, a name with a suffix of up to three letters in two: the longest name that a word starts with, and the rest. Encoded piece by piece, a name has the same ids wherever it stands."""

    def apart(word: Column) -> Column:
        z = name_and_rest(word, names, longest_suffix)
        return F.when(z["rest"] == "", F.array(z["name"])).otherwise(F.array(z["name"], z["rest"]))

    return F.flatten(F.transform(T.words(text), apart))


def positions_of(pieces: Column, name: Column) -> Column:
    """Numbers of the pieces that share a character with the first place at which a name stands in the pieces' joined text."""
    def places(start: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            end = s["at"] + p["n"]
            here = (s["at"] < start - 1 + F.char_length(name)) & (end > start - 1)
            return F.struct(end.alias("at"), F.when(here, F.concat(s["out"], F.array(p["i"]))).otherwise(s["out"]).alias("out"))

        sized = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), F.char_length(p).alias("n")))
        none = F.array().cast("array<int>")
        return F.when(start == 0, none).otherwise(F.aggregate(sized, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"]))

    return T.let(F.position(name, F.array_join(pieces, "")), places)
