"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled into a deterministic transducer over the bytes of a word. Byte-pair encoding has the property that the encoding of every
prefix ends in exactly one token which is compatible with the token before it, so the state only needs, for each place where a longer token could still
have begun, the last token there and its count relative to now. A transition says by how many tokens the count changes; a second table gives the change if the
byte is the word's last. States are made when first met, and the tables are begun anew beyond ``STATES``, so memory is bounded.

Texts are cut into chunks at fixed numbers of bytes. A chunk becomes a map from the state in which it is entered to the state in which it is left and the tokens between:
white space always leads to the start state, so all but the open word at either end of the chunk is a constant. Maps compose associatively and are
combined as a balanced tree, as in a parallel prefix scan.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows count each; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tables import need
from tesserine.llm.vocabulary import Vocabulary, byte_symbols

#: States kept before the tables are begun anew, and words whose path through them is kept as one transition.
STATES, WORDS = 200_000, 400_000
#: Bytes of a chunk.
CHUNK = 1 << 16
_SPACES = frozenset(b" \t\n\r\v\f")


class WordTransducer:
    """Counts the tokens of one word, given as bytes, for a byte-pair vocabulary with an end-of-word mark."""

    def __init__(self, merges: list, vocabulary: dict[str, int], end: str):
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.symbol, self.end = byte_symbols(), end
        inner = [t for t in vocabulary if not t.endswith(end)]
        self.tokens, self.last = set(inner), {t[: -len(end)] for t in vocabulary if t.endswith(end)}
        self.begins = {t[:k] for t in [*inner, *self.last] for k in range(1, len(t) + 1)}
        self.grows = {t[:k] for t in [*inner, *self.last] for k in range(1, len(t))}  # prefixes that a longer token goes on from
        self.fits: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        # a state: its transitions (byte -> next state, change), its ends (byte -> change), its suffix, and (length behind, token there, count relative to now)
        self.start = ({}, {}, "", ((0, None, 0),))
        self.states = {("", ((0, None, 0),)): self.start}

    def merge(self, parts: list[str]) -> list[str]:
        """Byte-pair encoding itself, of the few symbols of two tokens."""
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, before: str | None, token: str, final: bool) -> bool:
        """Whether the two tokens are their own encoding."""
        key = (before, token + self.end if final else token)
        if key not in self.fits:
            if len(self.fits) > 4 * STATES:
                self.fits.clear()
            symbols = [*(before or ""), *token]
            symbols[-1] += self.end if final else ""
            self.fits[key] = self.merge(symbols) == [t for t in key if t]
        return self.fits[key]

    def step(self, state: tuple, byte: int, final: bool) -> tuple:
        """The suffix with the byte, and the change of the count; ``final``: the byte ends the word."""
        _, _, suffix, places = state
        text = suffix + self.symbol[byte]
        known = self.last if final else self.tokens
        for behind, before, count in places:  # nearest places last: the longest token first
            token = text[len(text) - behind - 1:]
            if token in known and self.follows(before, token, final):
                return text, token, count + 1
        raise ValueError(f"no token ends with byte {byte}")

    def next(self, state: tuple, byte: int) -> tuple:
        text, token, change = self.step(state, byte, False)
        places = [(behind + 1, before, count - change) for behind, before, count in state[3] if text[len(text) - behind - 1:] in self.grows]
        suffix = text[len(text) - places[0][0]:] if places else ""
        key = (suffix, (*places, (0, token, 0)))
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = ({}, {}, *key)
        return found, change

    def count(self, word: bytes) -> int:
        if len(self.states) > STATES:
            self.clear()
        state, total = self.start, 0
        for b in word[:-1]:
            got = state[0].get(b)
            if got is None:
                got = state[0][b] = self.next(state, b)
            state, change = got
            total += change
        b = word[-1]
        change = state[1].get(b)
        if change is None:
            change = state[1][b] = self.step(state, b, True)[2]
        return total + change


class TextTransducer:
    """Counts the tokens of texts: special strings, normal form and split pattern around :class:`WordTransducer`."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        if not self.vocabulary.by_word:
            raise ValueError("only byte-level BPE vocabularies with an end-of-word mark, lower case and white space dropped are compiled")
        model, self.special = self.vocabulary.model, self.vocabulary.special
        self.bpe = WordTransducer(model["merges"], model["vocab"], model["end_of_word_suffix"])
        self.words: dict[bytes, int] = {}
        self.cores: dict[str, int] = {}

    def plain(self, text: str) -> int:
        total = 0
        for piece in self.vocabulary.pieces(text):
            n = self.cores.get(piece)
            if n is None:
                n = self.bpe.count(piece.encode())
                if len(self.cores) < WORDS and len(piece) < 64:
                    self.cores[piece] = n
            total += n
        return total

    def word(self, word: bytes) -> int:
        """From the start state over a word between white space and back to it."""
        n = self.words.get(word)
        if n is None:
            text = word.decode()
            parts = self.special.split(text) if self.special and "<" in text else [text]
            n = sum(map(self.plain, parts)) + len(parts) - 1
            if len(self.words) < WORDS and len(word) < 64:
                self.words[word] = n
        return n

    def chunk(self, chunk: bytes) -> tuple:
        """The chunk as a map: (open word before its first white space, tokens between, open word after its last), or (its bytes,) without white space."""
        words = chunk.split()
        head = b"" if chunk[0] in _SPACES else words[0]
        if len(head) == len(chunk):
            return (chunk,)
        tail = b"" if chunk[-1] in _SPACES else words[-1]
        inner = words[1 if head else 0:len(words) - 1 if tail else len(words)]
        counts = list(map(self.words.get, inner))
        if None in counts:
            for i in [i for i, n in enumerate(counts) if n is None]:
                counts[i] = self.word(inner[i])
        return head, sum(counts), tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        """First a, then b. Associative."""
        if len(a) == 1:
            return (a[0] + b[0],) if len(b) == 1 else (a[0] + b[0], *b[1:])
        if len(b) == 1:
            return *a[:2], a[2] + b[0]
        joint = a[2] + b[0]
        return a[0], a[1] + b[1] + (self.word(joint) if joint else 0), b[2]

    def count(self, text: str) -> tuple[int, int]:
        """Bytes and tokens of a text."""
        data = text.encode()
        maps = [self.chunk(data[i:i + CHUNK]) for i in range(0, len(data), CHUNK)]
        while len(maps) > 1:  # a balanced tree: each level composes neighbours
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0, 0
        n = 0 if len(maps[0]) == 1 else maps[0][1]
        return len(data), n + sum(self.word(w) for w in (maps[0][0], maps[0][-1] if len(maps[0]) > 1 else b"") if w)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = TextTransducer(tokenizer_path)
        for batch in batches:
            counts = [machine.count(t.as_py() or "") for t in batch.column(1)]
            n = [c[1] for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    return need(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
