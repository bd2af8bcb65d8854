"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges are compiled into a transducer that reads bytes. Two tokens may follow each other when
encoding their joined bytes gives the same two tokens back, and a text has exactly one sequence of
tokens whose neighbours all may follow each other: its encoding. So the nondeterministic
transducer walks a trie of the tokens, guesses where one ends, and keeps a guess only if the new
token may follow the one before. The deterministic states are the sets of live guesses. They are
made when first reached, and what all guesses of a state agree on is emitted. A guess lives no
longer than the longest token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import mapped, texts_only

# States and remembered matches after which a worker starts its tables anew.
MOST_STATES = 200_000
MOST_MATCHES = 300_000
# Text bytes that a worker encodes at a time.
STEP = 1 << 20
# Bytes of a match after which its state is remembered.
HEAD = 5
# A rank above all others.
NEVER = 1 << 60


def read_ranks(path: str) -> bytes:
    """A rank file as it is: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Transducer:
    """Encodes one match of the splitting pattern at a time; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.most_states = most_states
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.ends[node] = rank
        self.spines: dict[tuple[int, int], list[int]] = {}
        self.follows: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        # A guess is a trie node, the last token or -1, and the tokens not yet emitted; a state has
        # its guesses one after the other in one tuple, which takes half the memory of nested ones.
        # The guess at the root is the encoding of all that was read, and comes first.
        self.states: list[tuple] = [(0, -1, ())]
        self.number = {self.states[0]: 0}
        self.heads: dict[bytes, tuple[int, tuple]] = {}
        self.follows.clear()
        self.moves: list[dict[int, tuple[int, tuple]]] = [{}]
        self.no_moves: dict[int, tuple[int, tuple]] = {}

    def _spine(self, rank: int, side: int) -> list[int]:
        """The tokens that the first (``side`` 0) or last (-1) byte belongs to while merges build
        this token, from the byte up."""
        found = self.spines.get((rank, side))
        if found is None:
            parts = self._last_parts(self.token[rank])
            below = [] if parts is None else self._spine(self.ranks[parts[side]], side)
            found = self.spines[rank, side] = [*below, rank]
        return found

    def _last_parts(self, text: bytes) -> list[bytes] | None:
        """The two parts that the last merge of a token joins; None for a byte."""
        parts = [text[i: i + 1] for i in range(len(text))]
        while len(parts) > 2:
            _, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)
            )
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts if len(parts) == 2 else None

    def _check_follow(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens gives these two.

        A token has a higher rank than its parts, so the merges beside the border happen in the
        order of their ranks, of equal ones the left first. The two may follow if the tokens at
        the border never merge with each other before each is absorbed on its own side.
        """
        mine, other = self._spine(left, -1), self._spine(right, 0)
        i = j = 0
        while True:
            across = self.ranks.get(self.token[mine[i]] + self.token[other[j]], NEVER)
            before = mine[i + 1] if i + 1 < len(mine) else NEVER
            behind = other[j + 1] if j + 1 < len(other) else NEVER
            if before <= across and before <= behind and before != NEVER:
                i += 1
            elif across <= behind:
                return across == NEVER
            else:
                j += 1

    def _may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.follows.get(key)
        if found is None:
            found = self.follows[key] = self._check_follow(left, right)
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        """Make the transition of a state on a byte: the next state and what is emitted."""
        made, paths, whole, child, ends, inner = [], [], None, self.child, self.ends, self.inner
        guesses = iter(self.states[state])
        for node, last, path in zip(guesses, guesses, guesses):
            reached = child.get(node << 8 | byte)
            if reached is None:
                continue
            rank = ends[reached]
            if whole is None and rank >= 0 and (last < 0 or self._may_follow(last, rank)):
                whole, done = rank, (*path, rank)
            if inner[reached]:
                made += (reached, last, path)
                paths.append(path)
        agreed = min([len(done), *map(len, paths)])
        for at in range(agreed):
            token = done[at]
            if any([path[at] != token for path in paths]):
                agreed = at
                break
        emitted = done[:agreed]
        if agreed:
            done = done[agreed:]
            made[2::3] = [path[agreed:] for path in paths]
        made = (0, whole, done, *made)
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states)
            self.states.append(made)
            self.moves.append(self.no_moves)
        move = number, emitted
        if self.moves[state] is self.no_moves:
            self.moves[state] = {byte: move}
        else:
            self.moves[state][byte] = move
        return move

    def encode(self, match: bytes) -> tuple[int, ...]:
        """Tokens of one match; a match that is a token as a whole is that token."""
        whole = self.ranks.get(match)
        if whole is not None:
            return (whole,)
        if len(self.states) > self.most_states:
            self._restart()
        # Words share beginnings: their state after a few bytes is kept beside the moves.
        head = match[:HEAD]
        jump = self.heads.get(head)
        if jump is None:
            jump = self.heads[head] = self._walk(0, head)
        state, out = jump
        state, more = self._walk(state, match[HEAD:])
        return out + more + self.states[state][2]

    def _walk(self, state: int, text: bytes) -> tuple[int, tuple[int, ...]]:
        """The state after ``text``, and all that is emitted on the way."""
        out, moves = (), self.moves
        for byte in text:
            move = moves[state].get(byte)
            if move is None:
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        return state, out


class Utf8Stream:
    """Incremental UTF-8: bytes in any cut go in, whole characters come out.

    The state is how many bytes of the open character are there and how many it needs. Only the
    last bytes of a piece can leave a character open, so only they are walked one by one.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _needs(lead: int) -> int:
        return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4

    def feed(self, piece: bytes) -> str:
        piece = self.held + piece
        cut = len(piece)
        for back in range(1, min(3, len(piece)) + 1):
            byte = piece[-back]
            if byte >= 0xC0:
                if self._needs(byte) > back:
                    cut -= back
                break
            if byte < 0x80:
                break
        self.held = piece[cut:]
        return piece[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


def decode_stream(tokens: Iterable[int], token: dict[int, bytes], piece: int = 4096) -> Iterator[str]:
    """Text of a stream of tokens, ``piece`` tokens at a time."""
    stream, tokens = Utf8Stream(), iter(tokens)
    while waiting := list(islice(tokens, piece)):
        yield stream.feed(b"".join(map(token.__getitem__, waiting)))
    yield stream.close()


class Matches(dict):
    """Tokens of the matches met so far; a match is encoded where it is first asked for."""

    def __init__(self, encode: Callable[[bytes], tuple[int, ...]], kept: Iterable = ()):
        super().__init__(kept)
        self.encode = encode

    def __missing__(self, match: str) -> tuple[int, ...]:
        found = self[match] = self.encode(match.encode("utf-8", "replace"))
        return found


class Codec:
    """Splits a text by ``pattern`` and encodes every match by itself."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.transducer = Transducer(parse_ranks(content))
        self.split = regex.compile(pattern).findall
        self.known = Matches(self.transducer.encode)
        self.decimal = {number: str(number) for number in self.transducer.token}

    def encode(self, text: str) -> list[int]:
        """Tokens of all matches."""
        if len(self.known) > MOST_MATCHES:
            # Recent matches stay, so that frequent ones are not encoded again.
            self.known = Matches(self.transducer.encode, list(self.known.items())[MOST_MATCHES // 2:])
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def written(self, tokens: Iterable[int]) -> str:
        """Decimal numbers of the tokens, joined by spaces."""
        return " ".join(map(self.decimal.__getitem__, tokens))

    def decode(self, tokens: Iterable[int]) -> str:
        return "".join(decode_stream(tokens, self.transducer.token))


@lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> Codec:
    """One codec for all the batches of a worker."""
    return Codec(content, pattern)


def encode_documents(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """``doc_id, tokens, decoded`` of every text: its token numbers, and the text they give back.

    A null text is encoded as an empty one, which has no tokens. Rows of one id are separate.
    """

    def run(step: pa.RecordBatch) -> dict:
        tool = codec(content, pattern)
        tokens = [tool.encode(text or "") for text in step.column("text").to_pylist()]
        return {
            "doc_id": step.column("doc_id"),
            "tokens": pa.array(tokens, pa.list_(pa.int32())),
            "decoded": pa.array([tool.decode(t) for t in tokens], pa.string()),
        }

    return mapped(texts_only(docs), "text", run, "doc_id long, tokens array<int>, decoded string", STEP)


def digest_documents(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, without the tokens."""

    def run(step: pa.RecordBatch) -> dict:
        tool = codec(content, pattern)
        n, ids, back = [], [], []
        for text in step.column("text").to_pylist():
            tokens = tool.encode(text or "")
            n.append(len(tokens))
            ids.append(hashlib.sha256(tool.written(tokens).encode()).hexdigest())
            back.append(hashlib.sha256(tool.decode(tokens).encode()).hexdigest())
        return {
            "doc_id": step.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
            "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string()),
        }

    return mapped(
        texts_only(docs), "text", run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", STEP,
    )


def encoded_rows(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """``doc_id, source, tokens, n_tokens, exact`` of every row; ``exact``: the tokens give the text back."""

    def run(step: pa.RecordBatch) -> dict:
        tool = codec(content, pattern)
        texts = [text or "" for text in step.column("text").to_pylist()]
        tokens = [tool.encode(text) for text in texts]
        return {
            "doc_id": step.column("doc_id"), "source": step.column("source"),
            "tokens": pa.array(tokens, pa.list_(pa.int32())),
            "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
            "exact": pa.array([tool.decode(t) == text for t, text in zip(tokens, texts)], pa.bool_()),
        }

    return mapped(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"),
        "text", run, "doc_id long, source string, tokens array<int>, n_tokens long, exact boolean", STEP,
    )
