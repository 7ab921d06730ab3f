"""BPE encoding and decoding as streams with constant memory.

Encoding keeps, of a piece of text that has not ended, only as many bytes as may still change. How many that is follows
from the merge list: the *sufficient lookahead*. Take the merges of a text ``p`` and of a longer text that begins
with ``p``. They can first differ in a merge that reaches the end of ``p``, and the difference can then only travel
left, each time through a merge that comes later in the list and overlaps the one before. ``lookahead`` is the length
of the longest such chain, so every token that ends that far before the end of what was read is final.

Decoding is a state machine from tokens to text: it keeps the bytes of a character that is not complete yet.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from nbquarry.llm.common import col

# Bytes read beyond the lookahead before a piece is merged again; characters of text normalized at a time.
CHUNK, TEXT_CHUNK = 4096, 1 << 20
# Pieces that a worker remembers in each of two generations, and the longest ones remembered.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 64
# Up to this many symbols, looking through all pairs is faster than a heap.
SHORT = 64

# White space of the vocabulary's own patterns (the White_Space property of Unicode).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The usual pattern of such a vocabulary, and the same for Python's re: for lower-case ASCII, and for texts without numerals
# other than decimal digits, in which the letters are what re calls word characters but for digits and "_".
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Only the last two alternatives can begin with the same character, so letters, the most frequent, may come first.
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_ASCII = re.compile(rf"[a-z]+|[0-9]|{_ENDINGS}|[^{WHITE}a-z0-9]+").findall
_LETTERS = re.compile(rf"[^\W\d_]+|\d|{_ENDINGS}|(?:[^{WHITE}\w]|_)+").findall
_NUMERALS = regex.compile(r"[\p{Nl}\p{No}]").search
_WHITE_NEXT = re.compile(f"[{WHITE}]").search


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(printable))
    return names


class Recent:
    """What was used lately: when a generation is full, it becomes the older one, and the one before is dropped."""

    def __init__(self, make):
        self._make, self._new, self._old = make, {}, {}

    def all(self, keys: list[str]) -> list[bytes]:
        found = list(map(self._new.get, keys))
        for i in [i for i, f in enumerate(found) if f is None]:
            found[i] = self._find(keys[i])
        return found

    def _find(self, key: str) -> bytes:
        found = self._new.get(key)
        if found is None:
            found = self._old.get(key)
            if found is None:
                found = self._make(key)
                if len(key) > REMEMBERED_LENGTH:
                    return found
            if len(self._new) >= REMEMBERED:
                self._new, self._old = {}, self._new
            self._new[key] = found
        return found


class Vocabulary:
    """A BPE vocabulary with byte-level symbols, as read from a tokenizer's JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        kinds = [n["type"] for n in _listed(spec["normalizer"], "normalizers")]
        steps = _listed(spec["pre_tokenizer"], "pretokenizers")
        split = next((s for s in steps if s["type"] == "Split"), None)
        self._require(model["type"] == "BPE" and model["unk_token"] is None and not model["dropout"], "model")
        self._require(not model["continuing_subword_prefix"] and not model.get("byte_fallback") and not model.get("ignore_merges"), "model")
        self._require(kinds == ["NFC", "Replace", "Lowercase"], "normalizer")
        self._require([s["type"] for s in steps] == ["Split", "ByteLevel"] and split["invert"] and split["behavior"] == "Removed", "pre-tokenizer")
        self._require(spec["decoder"] is None, "decoder")
        self.suffix = model["end_of_word_suffix"] or ""
        # The pattern's own \s is narrower than that of the regex module.
        pattern = split["pattern"]["Regex"]
        self._usual = pattern == PATTERN
        self._pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}")).findall
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        # Ids without a token stay None.
        self.names = np.full(max(self.text) + 1, None, object)
        self.names[list(self.text)] = list(self.text.values())
        self._whole = len(self.text) == len(self.names)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = byte_names()
        self.inner = [vocabulary[names[b]] for b in range(256)]
        self.final = [vocabulary[names[b] + self.suffix] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # By the left token of a pair, then the right one.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocabulary[a]].setdefault(vocabulary[b], rank)
        self.merged = [vocabulary[a + b] for a, b in pairs]
        values = {n: b for b, n in names.items()}
        self._values = values
        self._strings = [self._symbols(a) + self._symbols(b) for a, b in pairs]
        self.lookahead = sufficient_lookahead(self._strings)
        self.size = {vocabulary[a + b]: len(s) for (a, b), s in zip(pairs, self._strings)} | dict.fromkeys(self.inner + self.final, 1)
        self._known = Recent(self._piece_ids)

    @staticmethod
    def _require(holds: bool, part: str) -> None:
        if not holds:
            raise ValueError(f"this kind of {part} is not supported")

    def _symbols(self, token: str) -> tuple[int, ...]:
        """A token as byte symbols; the last byte of a word is a symbol of its own."""
        ends = bool(self.suffix) and token.endswith(self.suffix)
        values = [self._values[c] for c in (token[: -len(self.suffix)] if ends else token)]
        return tuple(values[:-1] + [values[-1] + 256] if ends else values)

    def token_bytes(self, token: int) -> tuple[bytes, bool]:
        """The bytes of a token and whether it ends a word; a special token's own text."""
        text = self.text[token]
        if text in self.special and self.special[text] == token:
            return text.encode(), False
        ends = bool(self.suffix) and text.endswith(self.suffix)
        return bytes(self._values[c] for c in (text[: -len(self.suffix)] if ends else text)), ends

    def listed(self, ids: np.ndarray) -> np.ndarray:
        """Those of ``ids`` that the vocabulary has."""
        if len(ids) and ids.max() >= len(self.names):
            ids = ids[ids < len(self.names)]
        return ids if self._whole else ids[self.names[ids] != None]  # noqa: E711

    def merge(self, symbols: list[int]) -> list[int]:
        """Tokens of a run of symbols: the merge that comes first in the list, leftmost first."""
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        token, after, merged, none = list(symbols), self.ranks, self.merged, len(self.merged)
        ranks = [after[a].get(b, none) for a, b in zip(token, token[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            token[i] = new = merged[rank]
            del token[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = after[new].get(token[i + 1], none)
            if i:
                ranks[i - 1] = after[token[i - 1]].get(new, none)
        return token

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs and links between neighbours."""
        n, gone = len(symbols), -1
        get = lambda a, b: self.ranks[a].get(b)
        token, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i, (a, b) in enumerate(zip(token, token[1:])) if (rank := get(a, b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # A pair that has changed since is another pair, with its own entry.
            if token[i] == gone or j >= n or get(token[i], token[j]) != rank:
                continue
            token[i], token[j] = self.merged[rank], gone
            after[i] = after[j]
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    before[right] = left
                    if (found := get(token[left], token[right])) is not None:
                        heapq.heappush(heap, (found, left))
        return [t for t in token if t != gone]

    def piece(self, data: bytes, chunk: int = CHUNK) -> Iterator[int]:
        """Tokens of one piece, of which at most ``lookahead + chunk`` bytes are held at a time."""
        end, inner = 0, self.inner
        held: list[int] = []
        while True:
            if end < len(data):
                more = data[end:end + self.lookahead + chunk - len(held)]
                end += len(more)
                held += [inner[b] for b in more]
            if end == len(data):
                held[-1] = self.final[data[-1]]
                yield from self.merge(held)
                return
            stable = len(held) - self.lookahead
            done = 0
            for token in self.merge(held):
                if done + self.size[token] > stable:
                    break
                done += self.size[token]
                yield token
            held = held[done:]
            if not done:  # one token is longer than the chunk: read on
                chunk *= 2

    def _piece_ids(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > SHORT:
            return _packed(list(self.piece(data)))
        inner = self.inner
        symbols = [inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        return _packed(self.merge(symbols))

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalized text."""
        if not self._usual:
            return self._pattern(text)
        if text.isascii():
            return _ASCII(text)
        return self._pattern(text) if _NUMERALS(text) else _LETTERS(text)

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, as little-endian unsigned 32-bit integers."""
        out = []
        for part in self._special.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(_packed([self.special[part]]))
                continue
            for chunk in _chunks(part):
                out += self._known.all(self.pieces(_normal(chunk)))
        return b"".join(out)


def _chunks(text: str) -> Iterator[str]:
    """A text in parts that begin with white space, across which nothing is composed and no piece goes on."""
    start = 0
    while len(text) - start > TEXT_CHUNK and (white := _WHITE_NEXT(text, start + TEXT_CHUNK)):
        yield text[start:white.start()]
        start = white.start()
    yield text[start:] if start else text


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _listed(part: dict | None, key: str) -> list[dict]:
    return [] if part is None else part.get(key, [part])


def _normal(text: str) -> str:
    """Composed and in lower case, letter by letter: a sigma at the end of a word is like any other."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def sufficient_lookahead(strings: list[tuple[int, ...]]) -> int:
    """Bytes before the end of a text beyond which no longer text can change a token.

    ``strings``: what each merge produces, in the order of the list. ``reach[i]`` is how far before the end merge ``i``
    can start if it is the last of a chain: its own length if it touches the end, or that of an earlier merge ``j``
    that starts inside it and agrees with it as far as both go, plus the distance between their starts.
    """
    by_prefix: dict[tuple, int] = {}
    exact: dict[tuple, int] = {}
    longest = 1
    for s in strings:
        reach = len(s)
        for start in range(1, len(s)):
            rest = s[start:]
            found = by_prefix.get(rest, 0)
            for end in range(1, len(rest)):
                found = max(found, exact.get(rest[:end], 0))
            if found:
                reach = max(reach, found + start)
        for end in range(1, len(s) + 1):
            by_prefix[s[:end]] = max(by_prefix.get(s[:end], 0), reach)
        exact[s] = max(exact.get(s, 0), reach)
        longest = max(longest, reach)
    return longest


class TokenNames:
    """Ids to the names of their tokens with one space between: what a vocabulary without a decoder decodes to."""

    def __init__(self, vocabulary: Vocabulary):
        self._names, self._first = vocabulary.names, True

    def feed(self, ids: np.ndarray) -> str:
        text = " ".join(self._names[ids].tolist())
        if len(ids) and not self._first:
            text = " " + text
        self._first = self._first and not len(ids)
        return text

    def finish(self) -> str:
        return ""


class PlainText:
    """Ids to readable text: bytes to characters, one space after each word. Broken characters become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        self._state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self._space = False

    def feed(self, ids: np.ndarray) -> str:
        out = []
        for i in ids.tolist():
            data, ends = self._vocabulary.token_bytes(i)
            if self._space:
                out.append(" ")
            self._space = ends
            out.append(self._state.decode(data, final=ends))
        return "".join(out)

    def finish(self) -> str:
        return self._state.decode(b"", final=True)


_LOADED: dict[str, Vocabulary] = {}


def _shared(spark: SparkSession, path: str):
    """A function that gives the vocabulary on the workers, built once in each.

    The file, a few MB of fixed size, is broadcast, so that executors need not have it.
    """
    with open(path, encoding="utf-8") as file:
        text = file.read()
    key, broadcast = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)

    def load() -> Vocabulary:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Vocabulary(broadcast.value)
        return _LOADED[key]

    return load


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole ``text`` as binary ``name``: little-endian unsigned 32-bit integers.

    ``path`` is the tokenizer's JSON file on the driver. Special tokens in the text get their ids; none are added. NULL and
    empty texts give no ids. Repeated rows are encoded alike, an empty table gives an empty one. A column called ``name`` is
    replaced; all others stay.
    """
    load = _shared(docs.sparkSession, path)

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        vocabulary = load()
        return pa.array([vocabulary.encode(t.as_py() or "") for t in texts], pa.binary())

    return docs.withColumn(name, of(col(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded", plain: bool = False) -> DataFrame:
    """``encoded`` with the text of the binary ``ids`` as string ``name``; NULL or empty ids give an empty text.

    Ids that the vocabulary does not have are left out, as the library does, and so are up to three bytes at the end that
    are no whole id. Repeated rows are decoded alike, an empty table gives an empty one. By default token names with spaces
    between, which is what a vocabulary without a decoder stands for; ``plain`` gives readable text instead.
    """
    load = _shared(encoded.sparkSession, path)
    machine = PlainText if plain else TokenNames

    def text(vocabulary: Vocabulary, data: bytes) -> str:
        state = machine(vocabulary)
        every = np.frombuffer(data, "<u4", len(data) // 4)
        parts = (vocabulary.listed(every[i:i + CHUNK]) for i in range(0, len(every), CHUNK))
        return "".join([*map(state.feed, parts), state.finish()])

    @F.arrow_udf("string")
    def of(values: pa.Array) -> pa.Array:
        vocabulary = load()
        return pa.array([text(vocabulary, v.as_py() or b"") for v in values], pa.string())

    return encoded.withColumn(name, of(col(ids)))
