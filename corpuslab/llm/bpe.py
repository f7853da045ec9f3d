"""BPE encoding and decoding by a trie of words.

The encoding of a word is fixed by one state per prefix: the last token of the prefix's own encoding. Token t ends the
encoding of prefix p if p is q + t, t encodes to itself, and t may follow the last token of q: the two side by side are
not merged otherwise. Distinct words go into a trie whose nodes are symbols; a depth-first walk computes each node's
state from those above it, once for all words that share the prefix.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslab.session import in_arrow

#: White space to some regular expressions and not to others.
_ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Generations:
    """A bounded memory of two halves: when the younger is full the older goes; what is asked for stays young."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def turned(self) -> dict:
        """The younger half, which is new if it was full."""
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        return self.young

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys that are not known; the known ones are in young then, until the next call."""
        young, old = self.turned(), self.old
        new = [k for k in keys if k not in young]
        if old:
            young.update([(k, old[k]) for k in new if k in old])
            new = [k for k in new if k not in old]
        return new


class WordTrieBpe:
    """A tokenizer file of the kind "BPE with word ends": NFC, white space to a space, lower case, pattern split, byte-level symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a BPE file of the kind this class reads")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        # of each token: the rank of the merge that makes it, and the two tokens that it joins
        self.halves: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, t) in self.ranks.items():
            self.halves.setdefault(t, (rank, a, b))
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = {x[:2] for x in self.special}
        self.symbols = byte_symbols()
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        bodies = {t.removesuffix(self.end) if self.end and t != self.end else t for t in self.vocab}
        self.starts = {t[:n] for t in bodies for n in range(1, len(t) + 1)}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.inner_ends: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
        self.last_ends: dict[str, tuple[tuple[int, int], ...]] = {}
        self.words = Generations(KNOWN_WORDS)

    # ---- pieces

    def merged(self, parts: list[int]) -> list[int]:
        """Merges by rank until none applies: the definition, used on the symbols of one or two tokens."""
        while len(parts) > 1:
            best = min((self.ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks) if any(p in self.ranks for p in zip(parts, parts[1:], strict=False)) else None
            if best is None:
                break
            i = best[1]
            parts = [*parts[:i], self.ranks[parts[i], parts[i + 1]][1], *parts[i + 2 :]]
        return parts

    def atoms(self, token: int) -> list[int]:
        text = self.strings[token]
        body = text.removesuffix(self.end) if self.end and text != self.end else text
        out = [self.vocab[c] for c in body]
        if body != text:
            out[-1] = self.vocab[body[-1] + self.end]
        return out

    def is_whole(self, token: int) -> bool:
        """Whether the token's own symbols encode to it."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.atoms(token)) == [token]
        return known

    def may_follow(self, pair: int) -> bool:
        """Whether the left token (upper 32 bits) and the right one stay apart when their symbols are encoded side by side.

        Symbols of the two are merged in the order of ranks, so what stands at their border at any time is the end of the left token and the beginning of the right one, each as
        far as it has been put together: the two halves of tokens are looked at from the last merge backwards. A pair at the border is merged if its rank is less than that of
        the merge that ends its time at the border.
        """
        if len(self.follows) >= KNOWN_STATES:
            self.follows.clear()
        left, right, until = pair >> 32, pair & 0xFFFFFFFF, len(self.ranks)
        found = True
        while True:
            met = self.ranks.get((left, right))
            # of equal ranks the leftmost pair goes first: a merge inside the left token comes before one over the border, and that before one inside the right token
            if met is not None and met[0] < until:
                found = False
                break
            of_left, of_right = self.halves.get(left), self.halves.get(right)
            if of_left is None and of_right is None:
                break
            if of_right is None or (of_left is not None and of_left[0] > of_right[0]):
                until, left = of_left[0], of_left[2]
            else:
                until, right = of_right[0] + 1, of_right[1]
        self.follows[pair] = found
        return found

    def tail(self, tail: str) -> str:
        """The longest end of a string that a token starts with."""
        while tail and tail not in self.starts:
            tail = tail[1:]
        return tail

    def ends(self, tail: str, suffix: str) -> tuple[tuple[int, int], ...]:
        """(symbols, token) of the tokens that a prefix with this tail can end in, the longest first."""
        tokens = ((len(tail) - i, self.vocab.get(tail[i:] + suffix)) for i in range(len(tail)))
        return tuple((n, t) for n, t in tokens if t is not None and self.is_whole(t))

    def inner(self, grown: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """The tail of a prefix from that of the one before it and the symbol between them, and the tokens that it can end in; remembered by `grown`."""
        if len(self.inner_ends) >= KNOWN_STATES:
            self.inner_ends.clear()
        tail = self.tail(grown)
        found = self.inner_ends[grown] = (tail, self.ends(tail, ""))
        return found

    def last(self, grown: str) -> tuple[tuple[int, int], ...]:
        """The tokens that a word can end in whose prefix without the last symbol has the tail grown[:-1]."""
        if len(self.last_ends) >= KNOWN_STATES:
            self.last_ends.clear()
        found = self.last_ends[grown] = self.ends(self.tail(grown), self.end)
        return found

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The encodings of distinct words given in byte symbols.

        The trie of the words is kept as their sorted list, which visits its nodes depth first: a word shares with the one before it the nodes of their common beginning, whose
        states are still on the stack, and adds nodes for the rest.
        """
        out: dict[str, tuple[int, ...]] = {}
        follows, may_follow, inner_ends, last_ends = self.follows, self.may_follow, self.inner_ends, self.last_ends
        # of each prefix on the way to the present node: its last token, that token's symbols, and the prefix's tail
        states, lengths, tails, before = [-1], [0], [""], ""
        for word in sorted(words):
            inner, shared = len(word) - 1, 0
            most = min(inner, len(states) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], lengths[shared + 1 :], tails[shared + 1 :]
            tail = tails[shared]
            for depth in range(shared + 1, inner + 1):
                grown = tail + word[depth - 1]
                tail, ends = inner_ends.get(grown) or self.inner(grown)
                for size, token in ends:
                    if size == depth:
                        break
                    pair = states[depth - size] << 32 | token
                    if follows[pair] if pair in follows else may_follow(pair):
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                states.append(token)
                lengths.append(size)
                tails.append(tail)
            grown = tail + word[inner]
            for size, token in last_ends.get(grown) or self.last(grown):
                if size == inner + 1:
                    break
                pair = states[inner + 1 - size] << 32 | token
                if follows[pair] if pair in follows else may_follow(pair):
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids, n = [token], inner + 1 - size
            while n:
                ids.append(states[n])
                n -= lengths[n]
            ids.reverse()
            out[word] = tuple(ids)
            before = word
        return out

    # ---- texts

    def spelled(self, chunk: str) -> list[str]:
        """The words of an ASCII run in byte symbols, which printable ASCII characters are themselves."""
        if chunk.isalpha():
            return [chunk.lower()]
        words = self.pattern.findall(chunk.lower())
        return words if chunk.isprintable() else ["".join([self.symbols[b] for b in w.encode()]) for w in words]

    def spelled_beyond(self, chunks: list[str]) -> list[list[str]]:
        """The words of runs beyond ASCII, by the file's own normalizer and splitter, whose Unicode tables count: many runs to a call, with spaces between, as neither looks across a space."""
        normal = self.normalizer.normalize_str(" ".join(chunks))
        if normal.count(" ") != len(chunks) - 1:  # one of them has white space of its own, or none is left of it
            return [[w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(c))] for c in chunks]
        out, at, end = [[]], 0, normal.find(" ")
        for word, (start, _) in self.splitter.pre_tokenize_str(normal):
            while 0 <= end < start:
                out.append([])
                at += 1
                end = normal.find(" ", end + 1)
            out[at].append(word)
        return out + [[] for _ in range(len(chunks) - len(out))]

    def encode_chunks(self, runs: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each run, in which special tokens' strings stand for themselves and the pattern finds words in the rest."""
        found: dict[str, list] = {}
        beyond = []
        for run in runs:
            if self.split_special and any(m in run for m in self.marks):
                found[run] = [y for x in self.split_special.split(run) for y in ([self.special[x]] if x in self.special else self.spelled(x) if x.isascii() and not _ODD.search(x) else self.spelled_beyond([x])[0] if x else ())]
            elif run.isascii() and not _ODD.search(run):
                found[run] = self.spelled(run)
            else:
                beyond.append(run)
        for i in range(0, len(beyond), TOGETHER):
            found.update(zip(beyond[i : i + TOGETHER], self.spelled_beyond(beyond[i : i + TOGETHER]), strict=True))
        new = self.words.missing({w for words in found.values() for w in words if isinstance(w, str)})
        done = self.words.young
        done.update(self.encode_words(new))
        return {run: done[words[0]] if len(words) == 1 and isinstance(words[0], str) else tuple([i for w in words for i in (done[w] if isinstance(w, str) else (w,))]) for run, words in found.items()}

    def decode(self, ids: Iterable[int]) -> str:
        """As without a decoder: the tokens' strings joined by a space. Ids outside the vocabulary are left out."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_LOADED: dict[str, WordTrieBpe] = {}


def loaded(path: str) -> WordTrieBpe:
    if path not in _LOADED:
        _LOADED[path] = WordTrieBpe(path)
    return _LOADED[path]


#: Pieces of runs and words whose encodings a worker keeps in each half of its memory, and bytes of texts taken at a time.
KNOWN_PIECES, KNOWN_WORDS, AT_ONCE = 100_000, 80_000, 8_000_000

#: Prefixes and pairs of tokens of which a worker keeps what it found; runs beyond ASCII in one call of the library.
KNOWN_STATES, TOGETHER = 250_000, 200

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_CORE = f"^[^{re.escape(_MARKS)}]*"


class Pieces:
    """Encodings of pieces of texts, kept by a worker from task to task.

    A piece is a run without white space. Where a run is a word of letters and marks after it, the two are pieces, as they encode on their own; capitals of ASCII
    runs become small letters. A run that may hold a special token is left as it is. encode: what is kept of new pieces, by piece.
    """

    def __init__(self, encode: Callable[[list[str]], dict], size: int = KNOWN_PIECES) -> None:
        self.encode, self.known = encode, Generations(size)

    def values(self, wanted: list[str]) -> list:
        """What is kept of each piece: one look at the younger half for what is there, one more at the older half for the rest."""
        known = self.known.turned()
        out = list(map(known.get, wanted))
        gaps = [i for i, v in enumerate(out) if v is None]
        if gaps:
            old, new = self.known.old, []
            for i in gaps:
                piece = wanted[i]
                value = old.get(piece)
                if value is None:
                    new.append(piece)
                else:
                    out[i] = known[piece] = value
            if new:
                made = self.encode(new)
                known.update(made)
                for i in gaps:
                    if out[i] is None:
                        out[i] = made[wanted[i]]
        return out

    def texts(self, texts: pa.Array) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """For some texts at a time: what is kept of their distinct pieces, the number of each piece in turn, and where each text's pieces end."""
        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, side="right")))
            lists = pc.ascii_split_whitespace(texts.slice(at, end - at))
            found = lists.flatten().dictionary_encode()
            runs = found.dictionary
            # a mark may join a small letter where it does not join its capital, so capitals beside marks are left to the normalizer
            low = pc.if_else(pc.and_not(pc.string_is_ascii(runs), pc.match_substring(runs, "<|")), pc.ascii_lower(runs), runs)
            core = pc.ascii_rtrim(low, characters=_MARKS)
            apart = pc.and_(pc.utf8_is_alpha(core), pc.less(pc.binary_length(core), pc.binary_length(low)))
            heads = pc.if_else(apart, core, low).dictionary_encode()
            tails = pc.replace_substring_regex(low.filter(apart), _CORE, "").dictionary_encode()
            words = [*heads.dictionary.to_pylist(), *tails.dictionary.to_pylist()]
            head, two = heads.indices.to_numpy(), apart.to_numpy(zero_copy_only=False)
            tail = np.zeros(len(head), np.int32)
            tail[two] = tails.indices.to_numpy() + np.int32(len(heads.dictionary))
            runs = found.indices.to_numpy()
            split = two[runs]
            upto = np.zeros(len(runs) + 1, np.int64)
            np.cumsum(split, out=upto[1:])
            upto += np.arange(len(upto))
            pair = np.empty(upto[-1], np.int32)
            pair[upto[:-1]] = head[runs]
            pair[upto[:-1][split] + 1] = tail[runs[split]]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
            yield self.values(words), pair, upto[ends]
            at = end


def flat_ids(values: list[bytes], runs: np.ndarray, ends: np.ndarray, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and where each text's end, from the bytes of their runs' ids; tail is added to each text."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), np.int32)
    starts = np.cumsum(sizes) - sizes
    each = sizes[runs]
    upto = np.concatenate([[0], np.cumsum(each)])
    kind = np.int32 if upto[-1] < 2**31 and len(flat) < 2**31 else np.int64  # half the memory where the places fit
    ids = flat[np.repeat((starts[runs] - upto[:-1]).astype(kind), each) + np.arange(upto[-1], dtype=kind)] if len(runs) else np.empty(0, np.int32)
    at = upto[ends]
    if tail is not None:
        ids = np.insert(ids, at[1:], tail).astype(np.int32)
        at = at + np.arange(len(at))
    return ids, at


_PIECES: dict[tuple[str, str], Pieces] = {}


def pieces(path: str, kind: str) -> Pieces:
    """The worker's memory of ids ("ids": their bytes) or of what digests() shows ("shown": number, ids and pieces as texts)."""
    if (path, kind) not in _PIECES:
        bpe = loaded(path)
        if kind == "ids":
            made = Pieces(lambda new: {c: np.array(ids, np.int32).tobytes() for c, ids in bpe.encode_chunks(new).items()})
        else:
            numbers, names = [str(i) for i in range(max(bpe.strings) + 1)], bpe.strings

            def shown(new: list[str]) -> dict[str, tuple[int, str, str]]:
                return {c: (len(ids), " ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids])) for c, ids in bpe.encode_chunks(new).items()}

            made = Pieces(shown)
        _PIECES[path, kind] = made
    return _PIECES[path, kind]


def uncollected(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """function without garbage collection while it runs: it makes millions of tuples and no cycles, so that counting references frees all of them."""

    def run(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from function(batches)
        finally:
            gc.enable()

    return run


def _ids(path: str, text_at: int):
    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path, "ids")
        for batch in batches:
            at = 0
            for values, runs, ends in known.texts(batch.column(text_at)):
                ids, offsets = flat_ids(values, runs, ends)
                part = batch.slice(at, len(ends) - 1)
                at += len(ends) - 1
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], [*batch.schema.names, "ids"])

    return run


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with a column ids (array<int>) after its own; a null text has no ids. docs must have no column ids."""
    if "ids" in docs.columns:
        raise ValueError("there is a column ids")
    schema = docs.limit(0).withColumn("ids", F.array().cast("array<int>")).schema
    return in_arrow(docs, _ids(path, docs.columns.index(text)), schema)


def _texts(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with a column decoded (string) after its own; special tokens stay."""
    if "decoded" in rows.columns:
        raise ValueError("there is a column decoded")
    schema = rows.limit(0).withColumn("decoded", F.lit("")).schema
    return in_arrow(rows, _texts(path, rows.columns.index(ids)), schema)


def _digests(path: str):
    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path, "shown")
        for batch in batches:
            at = 0
            for values, runs, ends in known.texts(batch.column(1)):
                sizes = np.array([v[0] for v in values], np.int64)
                coded, decoded = ([v[k] for v in values] for k in (1, 2))
                upto = np.concatenate([[0], np.cumsum(sizes[runs])])[ends]
                some = np.flatnonzero(sizes[runs])  # a run may be empty
                runs, ends = runs[some], np.searchsorted(some, ends)
                hashes = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    mine = runs[a:b].tolist()
                    hashes.append([hashlib.sha256(" ".join([x[i] for i in mine]).encode()).hexdigest() for x in (coded, decoded)])
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(upto)), pa.array([h[0] for h in hashes], pa.string()), pa.array([h[1] for h in hashes], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += n
            pa.default_memory_pool().release_unused()

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's text, encoded and decoded; null and blank texts have no tokens.
    Repeated rows and doc_ids give a row each; an empty table gives none; other columns are ignored."""
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
