"""Token counts by a compiled finite-state tokenizer.

Method.  The tokenizer file (byte-level BPE with word ends) is compiled into a
deterministic transducer over the bytes of a word.  After each byte the last
token of the encoding of what was read is unique: it is the one vocabulary token
ending there that forms a valid pair with the last token before it (two tokens
are a valid pair if encoding their joined bytes gives them back).  A state holds
the bytes that may still become part of a token together with the last token and
the relative count at each place inside them; a transition is annotated with the
change of the token count, the transition at the word's end with the final
change.  States are made when first reached and kept.

A whole text is cut into chunks.  The end of a pre-token takes the transducer
back to its start state: at white space, beside a digit, and where a letter is
followed by no letter, whatever comes before and after.  So the state map of a
chunk is its head (still to be read from the incoming state), the tokens the
transducer emits between the first and the last such place, and its tail (the
outgoing state).  Head and tail are the unfinished pre-tokens at the edges; a
chunk inside one pre-token is all head and is read when the pre-token is whole.
Such maps compose associatively; a text's maps are folded pairwise (log2(n)
rounds), no prefix is kept.

Scale.  Map-only; the compiled transducer is a cache per worker, bounded by
``MAX_STATES`` and ``MAX_WORDS`` (then it starts anew), never part of a result.
Memory is linear in the text for any text, also one without white space; time is
linear but for the log2(n) times a pre-token longer than a chunk is copied.  States
are made anew inside a word, too, when there are more than ``MAX_STATES``.

Edge cases.  Null texts count as empty: 0 bytes, 0 tokens.  Strings of special
tokens inside a text are one token each, as the library does by default.
Repeated rows count alike; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CHUNK = 1 << 15  # characters
LIMIT = 2048
MAX_STATES = 300_000
MAX_WORDS = 300_000
EDGE = 200  # characters up to which a chunk's edge is kept as it is
BYTES = 1 << 15  # of a word between two looks at the number of states

# white space for the tokenizer's \s; Python's str.split() also splits at \x1c-\x1f
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NOT_SPACE = "\x1c\x1d\x1e\x1f"

# the pre-token pattern that the places of _ENDS are certain for; other patterns end at white space only
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDS = r"(?<=\p{N})|(?=\p{N})|(?<=\p{L})(?=[^\s\p{L}])"
_FIRST_END, _LAST_END = regex.compile(_ENDS), regex.compile("(?r)" + _ENDS)


def byte_symbols() -> list[str]:
    """Character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the rest for 256 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Transducer:
    """Token counts of words, read byte by byte."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str):
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        spelled: dict[int, tuple[bytes, bool]] = {i: (bytes([b]), False) for b, i in enumerate(self.inner)}
        spelled |= {i: (bytes([b]), True) for b, i in enumerate(self.final)}
        for (a, b), (_, joined) in self.merges.items():
            if a in spelled and b in spelled and not spelled[a][1]:
                spelled[joined] = (spelled[a][0] + spelled[b][0], spelled[b][1])
        self.spelled = spelled
        self.tokens = ({}, {})  # bytes -> id: inside a word, at its end
        self.prefixes = set()  # proper prefixes of tokens
        for i, (text, end) in spelled.items():
            if self.encode(self.symbols(i)) == [i]:
                self.tokens[end][text] = i
                self.prefixes.update(text[:k] for k in range(len(text)))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((0, None, 0),))
        self.keys, self.numbers = [start], {start: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.ends: list[dict[int, int]] = [{}]

    def symbols(self, token: int) -> list[int]:
        text, end = self.spelled[token]
        out = [self.inner[b] for b in text]
        return [*out[:-1], self.final[text[-1]]] if end else out

    def encode(self, parts: list[int]) -> list[int]:
        """Merges of lowest rank first, leftmost first."""
        parts, get = list(parts), self.merges.get
        while len(parts) > 1:
            found = [(m[0], i) for i in range(len(parts) - 1) if (m := get((parts[i], parts[i + 1])))]
            if not found:
                break
            _, i = min(found)
            parts[i:i + 2] = [get((parts[i], parts[i + 1]))[1]]
        return parts

    def valid(self, left: int | None, right: int) -> bool:
        if left is None:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.encode(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def _next(self, state: int, byte: int, end: bool) -> tuple[int, int, tuple[bytes, tuple]]:
        """(last token, change of the count, window read so far) after ``byte``."""
        window, places = self.keys[state]
        read = window + bytes([byte])
        for back, last, count in places:
            token = self.tokens[end].get(read[len(window) - back:])
            if token is not None and self.valid(last, token):
                return token, count + 1, (read, places)
        raise AssertionError("a byte without a token")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count)."""
        token, change, (read, places) = self._next(state, byte, False)
        kept = [(0, token, 0)] + [(back + 1, last, count - change) for back, last, count in places
                                  if read[len(read) - 1 - back:] in self.prefixes]
        longest = kept[-1][0]
        key = (read[len(read) - longest:], tuple(kept))
        number = self.number(key)
        self.steps[state][byte] = (number, change)
        return number, change

    def number(self, key: tuple[bytes, tuple]) -> int:
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
            self.ends.append({})
        return number

    def end(self, state: int, byte: int) -> int:
        change = self.ends[state][byte] = self._next(state, byte, True)[1]
        return change

    def count(self, word: bytes) -> int:
        """Tokens of one word (at least one byte)."""
        state, total, last = 0, 0, len(word) - 1
        for at in range(0, last + 1, BYTES):
            if len(self.keys) > MAX_STATES:
                key = self.keys[state]
                self.reset()
                state = self.number(key)
            steps = self.steps
            for byte in word[at:min(at + BYTES, last)]:
                known = steps[state].get(byte)
                state, change = known if known is not None else self.step(state, byte)
                total += change
        change = self.ends[state].get(word[-1])
        return total + (change if change is not None else self.end(state, word[-1]))


class StateMap(NamedTuple):
    """State map of a chunk; ``emitted`` is None where no pre-token surely ends in
    it (then all of it is head)."""

    head: str
    emitted: int | None
    tail: str


def compose(a: StateMap, b: StateMap, count: Callable[[str], int]) -> StateMap:
    """The map of ``a`` followed by ``b``."""
    if a.emitted is None:
        return StateMap(a.head + b.head, b.emitted, b.tail)
    if b.emitted is None:
        return StateMap(a.head, a.emitted, a.tail + b.head)
    return StateMap(a.head, a.emitted + count(a.tail + b.head) + b.emitted, b.tail)


def scan(maps: list[StateMap], count: Callable[[str], int]) -> list[StateMap]:
    """Inclusive prefix scan: the map of chunks 0..i for each i."""
    if len(maps) < 2:
        return list(maps)
    pairs = scan([compose(a, b, count) for a, b in zip(maps[::2], maps[1::2])], count)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i], count))
    return out


def fold(maps: list[StateMap], count: Callable[[str], int]) -> StateMap:
    """The map of all chunks (at least one); what is composed is let go."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else []
        maps = [compose(a, b, count) for a, b in zip(maps[::2], maps[1::2])] + odd
    return maps[0]


class Counter(dict):
    """Counts tokens of texts; a dict of the counts of words between white space."""

    def __init__(self, path: str, text: str | None = None):
        """From the tokenizer file at ``path``, or from its ``text`` (``path`` then only names it)."""
        super().__init__()
        if text is None:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        spec = json.loads(text)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not model["end_of_word_suffix"] \
                or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a lower-casing byte-level BPE with word ends")
        self.transducer = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cuts = split["pattern"]["Regex"] == _PATTERN
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marker = special[0][:2] if special else ""

    def __missing__(self, piece: str) -> int:
        total = sum(self.transducer.count(w.encode()) for w in self.words.findall(piece))
        if len(self) >= MAX_WORDS:
            self.clear()
        if len(piece) < 200:
            self[piece] = total
        return total

    def chunk_map(self, chunk: str) -> StateMap:
        pieces = chunk.split() if not any(c in chunk for c in _NOT_SPACE) else [p for p in _SPACE.split(chunk) if p]
        opens, closes = _SPACE.match(chunk), _SPACE.match(chunk[-1:])
        if not pieces:
            return StateMap("", 0, "")
        head = "" if opens else pieces.pop(0)
        if not pieces and not opens and not closes:
            if len(head) > EDGE and self.cuts and (end := _FIRST_END.search(head)):
                first, last = end.start(), _LAST_END.search(head).start()
                return StateMap(head[:first], self[head[first:last]], head[last:])
            return StateMap(head, None, "")
        tail = "" if closes or not pieces else pieces.pop()
        emitted = sum(map(self.__getitem__, pieces))
        if len(head) > EDGE and self.cuts and (end := _FIRST_END.search(head)):
            emitted += self[head[end.start():]]
            head = head[:end.start()]
        if len(tail) > EDGE and self.cuts and (end := _LAST_END.search(tail)):
            emitted += self[tail[:end.start()]]
            tail = tail[end.start():]
        return StateMap(head, emitted, tail)

    def of_segment(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # case by character: the library knows no rule for a final sigma
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        maps = [self.chunk_map(text[at:at + CHUNK]) for at in range(0, len(text), CHUNK)]
        if not maps:
            return 0
        whole = fold(maps, self.__getitem__)
        return self[whole.head] + (whole.emitted or 0) + (self[whole.tail] if whole.emitted is not None else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or self.marker not in text:
            return self.of_segment(text)
        segments = self.special.split(text)
        return len(segments) - 1 + sum(map(self.of_segment, segments))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.  The tokenizer file
    is read here and sent to the workers."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    key = (path, zlib.crc32(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _compiled(key, text)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


_COUNTERS: dict[tuple[str, int], Counter] = {}


def _compiled(key: tuple[str, int], text: str) -> Counter:
    """One compiled tokenizer per worker process."""
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(key[0], text)
    return _COUNTERS[key]
