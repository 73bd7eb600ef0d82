"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

The merges of a rank file are compiled into a finite-state transducer over bytes. A token may begin at any
byte; the set of tokens that are open at once is one determinised state, made when it is first reached
and kept in a table of limited size. A move on a byte gives the tokens that may end there. One of them
alone can follow the token before it (the two, joined and merged, stay these two), which a second lazily
filled table answers. Boundaries that longer input could still use are those before an open token; the
tokens up to where all their paths meet are certain and are emitted, so the lookahead is bounded by the
longest token and the emitting interval.

Decoding joins token bytes block by block; a state machine holds back the bytes of a character that a
block's end cuts, so text can be passed on while tokens still arrive.

Defined cases: a null text counts as empty and has no tokens; bytes that are not UTF-8 decode to U+FFFD
in the streamed text, and unchanged in the bytes; other columns are kept; equal rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

STATES = 200_000  # states kept before the table is begun anew
PAIRS = 500_000  # answers kept on which token may follow which
WORDS = 250_000  # encoded matches kept
LOOKAHEAD = 256  # open bytes from which certain tokens are emitted
NEVER = 1 << 62
LONG_WORD = 64  # characters beyond which a match is not kept
LONG_TEXT = 4_000_000  # characters beyond which matches are not listed at once
BLOCK = 65_536  # tokens decoded at a time


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64, blank, number on each line."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class _State:
    """All tokens that may be open, as the longest of their beginnings; the others are its suffixes."""

    __slots__ = ("open", "moves", "lengths")

    def __init__(self, pending: bytes, lengths: tuple[int, ...]):
        self.open, self.lengths = pending, lengths
        self.moves: dict[int, tuple] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self.width = max(ranks.values(), default=0) + 1
        self.state_limit, self.pair_limit = states, pairs
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, list | None] = {}
        self.reset()

    def reset(self) -> None:
        self.start = _State(b"", ())
        self.states = {b"": self.start}

    def move(self, state: _State, byte: int) -> tuple:
        """Determinise one step: the tokens that may end here, longest first, and the next state."""
        data = state.open + bytes((byte,))
        size = len(data)
        ending, lengths, pending = [], [], b""
        for begin in range(size):
            part = data[begin:]
            rank = self.ranks.get(part)
            if rank is not None:
                ending.append((size - begin, rank))
            if part in self.prefixes:
                pending = pending or part
                lengths.append(size - begin)
        if not ending:
            raise ValueError(f"no token ends with byte {byte}; the ranks lack single bytes")
        following = self.states.get(pending)
        if following is None:
            following = self.states[pending] = _State(pending, tuple(lengths))
        taken = state.moves[byte] = (tuple(ending), following)
        return taken

    def history(self, rank: int) -> list[tuple] | None:
        """How merging makes a token: (rank of the next merge, first part, last part) before each.

        None for a token that merging its bytes does not give.
        """
        if rank in self.made:
            return self.made[rank]
        token = self.bytes_of[rank]
        parts = [token[i : i + 1] for i in range(len(token))]
        steps: list[tuple] | None = []
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                found = self.ranks.get(parts[i] + parts[i + 1], NEVER)
                if found < best:
                    best, at = found, i
            steps.append((best, parts[0], parts[-1]))
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.made[rank] = steps if len(parts) == 1 else None
        return self.made[rank]

    def follows(self, left: int, right: int) -> bool:
        """Whether two tokens, joined and merged, stay these two; ``left`` is -1 at the start.

        Merges inside the two go on side by side, lowest rank first and left first among equals. The
        boundary falls if the pair across it comes before both.
        """
        second = self.history(right)
        if left < 0 or second is None:
            return second is not None
        first = self.history(left)
        i = j = 0
        while True:
            next_left, _, last = first[i]
            next_right, begin, _ = second[j]
            across = self.ranks.get(last + begin, NEVER)
            if across < next_left and across <= next_right and across != NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one match. A match that is a token as a whole is that token."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        if len(self.states) >= self.state_limit:
            self.reset()
        if len(self.pairs) >= self.pair_limit:
            self.pairs.clear()
        pairs, width = self.pairs, self.width
        state, emitted = self.start, []
        # For each boundary behind the emitted tokens: where its last token begins, and that token.
        begins, tokens, end = [0], [-1], 0
        for byte in piece:
            taken = state.moves.get(byte)
            if taken is None:
                taken = self.move(state, byte)
            ending, state = taken
            end += 1
            for length, rank in ending:
                left = tokens[end - length]
                key = (left + 1) * width + rank
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.follows(left, rank)
                if fits:
                    begins.append(end - length)
                    tokens.append(rank)
                    break
            else:
                raise ValueError("the ranks give no token here")
            if end >= LOOKAHEAD:
                cut = self._certain(begins, end, state)
                if cut:
                    self._emit(begins, tokens, cut, emitted)
                    # The last emitted token stays as the left neighbour of what follows.
                    begins = [0, *(b - cut for b in begins[cut + 1 :])]
                    tokens = tokens[cut:]
                    end -= cut
        self._emit(begins, tokens, end, emitted)
        return tuple(emitted)

    @staticmethod
    def _certain(begins: list[int], end: int, state: _State) -> int:
        """The last boundary on the paths of all boundaries where a token may still be open."""
        cut = end
        for length in state.lengths:
            other = end - length
            while other != cut:
                if other > cut:
                    other = begins[other]
                else:
                    cut = begins[cut]
        return cut

    @staticmethod
    def _emit(begins: list[int], tokens: list[int], end: int, emitted: list[int]) -> None:
        path = []
        while end:
            path.append(tokens[end])
            end = begins[end]
        emitted.extend(reversed(path))


class _Words(dict):
    """Encoded matches of the text pattern, kept up to a limit."""

    def __init__(self, transducer: Transducer, limit: int = WORDS):
        super().__init__()
        self.transducer, self.limit = transducer, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        tokens = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONG_WORD:
            if len(self) >= self.limit:
                self.clear()
            self[word] = tokens
        return tokens


class StreamDecoder:
    """UTF-8 state machine: complete characters go on, the bytes of a cut one wait for the next block."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue  # inside a character: look for its first byte
            needs = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            if needs > back:
                cut -= back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.words = _Words(Transducer(ranks))
        self.bytes_of = self.words.transducer.bytes_of

    def encode(self, text: str) -> np.ndarray:
        find = self.words.__getitem__
        if len(text) <= LONG_TEXT:
            tokens = chain.from_iterable(map(find, self.pattern.findall(text)))
            return np.fromiter(tokens, "<u4")
        matches = (match.group() for match in self.pattern.finditer(text))
        blocks = []
        while block := list(islice(matches, 500_000)):
            blocks.append(np.fromiter(chain.from_iterable(map(find, block)), "<u4"))
        return np.concatenate(blocks)

    def token_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def stream(self, ids: np.ndarray, block: int = BLOCK) -> Iterator[tuple[bytes, str]]:
        """Bytes of each block of tokens, and the text that is complete with it."""
        machine = StreamDecoder()
        for begin in range(0, len(ids), block):
            data = self.token_bytes(ids[begin : begin + block].tolist())
            yield data, machine.feed(data)
        yield b"", machine.close()

    def digest(self, text: str) -> tuple[int, str, str, bool, np.ndarray]:
        """Token count, SHA-256 of ids and of decoded bytes, whether the text came back, the ids."""
        ids = self.encode(text)
        decoded, at, same = hashlib.sha256(), 0, True
        for data, piece in self.stream(ids):
            decoded.update(data)
            same = same and text.startswith(piece, at)
            at += len(piece)
        return (
            len(ids),
            hashlib.sha256(ids.tobytes()).hexdigest(),
            decoded.hexdigest(),
            same and at == len(text),
            ids,
        )


def worker_tokenizer(data: bytes, pattern: str) -> Tokenizer:
    """One tokenizer per Python worker and vocabulary, so that later tasks find its tables filled."""
    kept = sys.modules.setdefault("_byte_bpe_tables", types.ModuleType("_byte_bpe_tables"))
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in kept.__dict__:
        kept.__dict__[key] = Tokenizer(read_ranks(data), pattern)
    return kept.__dict__[key]


def _each(data: bytes, pattern: str, function, kind: pa.DataType):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = worker_tokenizer(data, pattern)
        for batch in batches:
            yield pa.array([function(tokenizer, text) for text in batch.to_pylist()], kind)

    return run


DIGEST = (
    "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,round_trip:boolean,ids:array<int>>"
)
_DIGEST = pa.struct(
    [
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("round_trip", pa.bool_()),
        ("ids", pa.list_(pa.int32())),
    ]
)


def _digest_row(tokenizer: Tokenizer, text: str | None) -> dict:
    row = dict(zip(_DIGEST.names, tokenizer.digest(text or "")))
    return row | {"ids": row["ids"].astype("int32")}


def _short_digest_row(tokenizer: Tokenizer, text: str | None) -> dict:
    return dict(zip(_DIGEST.names, tokenizer.digest(text or "")[:-1]))


def _ids_row(tokenizer: Tokenizer, text: str | None) -> np.ndarray:
    return tokenizer.encode(text or "").astype("int32")


def _text_row(tokenizer: Tokenizer, ids: list[int] | None) -> str | None:
    if ids is None:
        return None
    return "".join(piece for _, piece in tokenizer.stream(np.asarray(ids, "<u4")))


def token_ids(text: Column, ranks: bytes, pattern: str) -> Column:
    """The token ids of a text column; ``ranks`` is the content of a rank file."""

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(ranks, pattern, _ids_row, pa.list_(pa.int32()))(batches)

    return encode(text)


def decoded_text(ids: Column, ranks: bytes, pattern: str) -> Column:
    """The text of a column of token ids; null for null."""

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(ranks, pattern, _text_row, pa.string())(batches)

    return decode(ids)


def token_digest(
    df: DataFrame, text: str, ranks: bytes, pattern: str, ids: str | None = None
) -> DataFrame:
    """Encode and decode ``text``; adds n_tokens, ids_sha256, decoded_sha256 and round_trip.

    With a name in ``ids`` the token ids are a column too.
    """
    row = _digest_row if ids else _short_digest_row

    @arrow_udf(DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _each(ranks, pattern, row, _DIGEST)(batches)

    added = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    kept = [name for name in df.columns if name not in (*added, ids)]
    digested = df.select(*[F.col(f"`{name}`") for name in kept], digest(F.col(text)).alias("__digest"))
    results = [F.col(f"__digest.{name}") for name in added]
    if ids:
        results.append(F.col("__digest.ids").alias(ids))
    return digested.select(*[F.col(f"`{name}`") for name in kept], *results)
