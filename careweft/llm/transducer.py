"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A token sequence is what the merges give exactly when each two neighbours are:
merging their joined bytes gives the two back. So the last token of every prefix
is decided by the last token of a shorter prefix. The transducer reads bytes; a
state is the set of starts at which a longer token is still open, each with the
last token before it. Tokens go out as soon as no start is open, so what is held
back never exceeds a match. States are made when they are first
reached and shared by all texts of a worker; the table of states is emptied when
it is full, which costs time and changes nothing else.

Decoding walks a UTF-8 machine from token to token: characters that span tokens
are held until they are whole.

Rows: null text counts as empty; an empty text has no ids; repeated rows and
repeated keys give a row each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweft.llm.words import WordMemo

MAX_STATES = 150_000
MAX_PAIRS = 500_000
BLOCK_IDS = 8192
BLOCK_BYTES = 1 << 20


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class State:
    """`tail`: the bytes since the earliest start that is still open; `lasts`: the
    last token before each open start, earliest first; the last of them stands for
    the end of the bytes read, so it is the token that ends there."""

    __slots__ = ("lasts", "settled", "tail")

    def __init__(self, tail: bytes, lasts: tuple[bytes, ...]):
        self.tail, self.lasts, self.settled = tail, lasts, len(lasts) == 1


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        # An entry that its own merges do not reach is only ever a whole match.
        self.reached = {token for token in ranks if len(token) == 1 or self._split(token)}
        self.whole_only = set(ranks) - self.reached
        self.lengths = np.zeros(max(ranks.values()) + 1, "i8")
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.in_order = all(ranks[t] > max(ranks[a], ranks[b]) for t, (a, b) in self.halves.items())
        self.stems = {t[:n] for t in self.reached for n in range(1, len(t))}
        self.left: dict[bytes, list] = {}
        self.right: dict[bytes, list] = {}
        self._reset()

    def _reset(self) -> None:
        self.states, self.numbers = [State(b"", (b"",))], {}
        self.moves: dict[tuple[bytes, int], tuple] = {}
        self.arcs = np.zeros((min(self.max_states, 4096), 256), "<i4")
        self.ends = np.zeros(len(self.arcs), "<i4")

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges themselves, down to `least` parts; for a token or two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            joined = parts[best] + parts[best + 1]
            if joined not in self.ranks:
                break
            parts[best : best + 2] = [joined]
        return parts

    def _split(self, token: bytes) -> bool:
        parts = self.merge(token, 2)
        if len(parts) == 2:
            self.halves[token] = (parts[0], parts[1])
        return len(parts) == 2

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at that end of `token` while it is merged, longest first, each
        with the rank of the merge that uses it up."""
        kept = (self.left, self.right)[side]
        if token not in kept:
            out, until = [(token, float("inf"))], token
            while until in self.halves:
                part = self.halves[until][side]
                out.append((part, self.ranks[until]))
                until = part
            kept[token] = out
        return kept[token]

    def _stays(self, a: bytes, b: bytes) -> bool:
        if not self.in_order:
            return self.merge(a + b) == [a, b]
        # A merge across the border happens if both its parts stand there at its
        # rank. Of equal ranks the left one goes first.
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def may_follow(self, a: bytes, b: bytes) -> bool:
        if not a:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stays(a, b)
        return known

    def _move(self, tail: bytes, byte: int) -> tuple:
        """What one more byte does to the open starts after `tail`: the tokens that
        may end here, the starts that stay open and the new tail."""
        text, ends, stay = tail + bytes((byte,)), [], []
        starts = [i for i in range(len(tail)) if tail[i:] in self.stems] + [len(tail)]
        for n, i in enumerate(starts):
            if text[i:] in self.reached:
                ends.append((n, text[i:]))
            if text[i:] in self.stems:
                stay.append(n)
        return ends, stay, text[starts[stay[0]] :] if stay else b""

    def _arc(self, number: int, byte: int) -> int:
        """Number of the state after `byte`; 0, the start, is never reached again and
        stands for an arc that is not made yet."""
        state = self.states[number]
        move = self.moves.get((state.tail, byte))
        if move is None:
            move = self.moves[state.tail, byte] = self._move(state.tail, byte)
        ends, stay, tail = move
        for n, token in ends:
            if self.may_follow(state.lasts[n], token):
                break
        else:
            raise ValueError(f"no token ends after {state.tail!r} {byte}")
        lasts = (*[state.lasts[n] for n in stay], token)
        following = self.numbers.get((tail, lasts))
        if following is None:
            following = self.numbers[tail, lasts] = len(self.states)
            self.states.append(State(tail, lasts))
            if following >= len(self.arcs):
                self.arcs = np.concatenate([self.arcs, np.zeros_like(self.arcs)])
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ends[following] = self.ranks[token]
        self.arcs[number, byte] = following
        return following

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Ids of one match that comes in parts, each as soon as no start is open
        that could still change it."""
        number, held = 0, []
        for byte in chain.from_iterable(parts):
            number = int(self.arcs[number, byte]) or self._arc(number, byte)
            state = self.states[number]
            held.append(state.lasts[-1])
            if state.settled:
                yield from self._settle(held)
                held = []
        yield from self._settle(held)

    def _settle(self, held: list[bytes]) -> list[int]:
        """`held`: the token that ends at each byte since the last settled place."""
        out, at = [], len(held)
        while at > 0:
            out.append(self.ranks[held[at - 1]])
            at -= len(held[at - 1])
        return out[::-1]

    def encode_many(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, one after the other, and the number of ids of each.
        All matches of a block take a byte at a time together."""
        if len(self.states) > self.max_states:
            self._reset()
        sizes = np.array([len(m) for m in matches], "i8")
        counts, found = np.zeros(len(matches), "i8"), []
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            width = int(sizes[order[at]])
            rows = order[at : at + max(1, BLOCK_BYTES // max(width, 1))]
            at += len(rows)
            ids, n = self._lockstep([matches[i] for i in rows], sizes[rows])
            counts[rows] = n
            found.append(ids)
        if not found:
            return np.zeros(0, "<u4"), counts
        # Blocks went by length; bring the ids back to the order of the matches.
        n = counts[order]
        starts = (np.cumsum(counts) - counts)[order]
        places = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.empty(int(n.sum()), "<u4")
        out[places] = np.concatenate(found)
        return out, counts

    def _lockstep(self, matches: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`matches` by falling length."""
        n, width = len(matches), int(sizes[0])
        table = np.zeros((n, width), "u1")
        table[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(matches), "u1")
        number, held = np.zeros(n, "i4"), np.zeros((n, width), "i4")
        active = np.searchsorted(-sizes, -np.arange(width), side="left")
        for j in range(width):
            k = active[j]
            now, byte = number[:k], table[:k, j]
            after = self.arcs[now, byte]
            unmade = np.flatnonzero(after == 0)
            if len(unmade):
                for key in np.unique(now[unmade].astype("i8") * 256 + byte[unmade]).tolist():
                    self._arc(key >> 8, key & 255)
                after = self.arcs[now, byte]
            number[:k] = after
            held[:k, j] = self.ends[after]
        kept, at, rows = np.zeros((n, width), bool), sizes.copy(), np.flatnonzero(sizes > 0)
        while len(rows):
            ends = at[rows] - 1
            kept[rows, ends] = True
            at[rows] -= self.lengths[held[rows, ends]]
            rows = rows[at[rows] > 0]
        if self.whole_only:
            for i, match in enumerate(matches):
                if match in self.whole_only:
                    kept[i], kept[i, 0], held[i, 0] = False, True, self.ranks[match]
        return held[kept].astype("<u4"), kept.sum(axis=1)


class Utf8Machine:
    """States: 0 between characters, otherwise (continuation bytes still due, the
    range of the next one). `step` gives None where no text can go on."""

    def __init__(self) -> None:
        self.arcs: dict[tuple, object] = {}

    @staticmethod
    def _byte(state: object, byte: int) -> object:
        if state == 0:
            if byte < 0x80:
                return 0
            if 0xC2 <= byte <= 0xDF:
                return (1, 0x80, 0xBF)
            if 0xE0 <= byte <= 0xEF:
                return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
            if 0xF0 <= byte <= 0xF4:
                return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
            return None
        due, low, high = state
        if not low <= byte <= high:
            return None
        return (due - 1, 0x80, 0xBF) if due > 1 else 0

    def step(self, state: object, token: bytes) -> object:
        key = (state, token)
        if key not in self.arcs:
            for byte in token:
                state = self._byte(state, byte)
                if state is None:
                    break
            self.arcs[key] = state
        return self.arcs[key]


class StreamDecoder:
    """Bytes and whole characters of ids that come in blocks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.machine = Utf8Machine()
        self.closed = np.array([t is not None and self.machine.step(0, t) == 0 for t in self.tokens])
        self.restart()

    def restart(self) -> None:
        self.state, self.held, self.valid = 0, b"", True

    def feed(self, ids: np.ndarray) -> tuple[bytes, str]:
        """Bytes of the block, and the text that is whole with it."""
        pieces = list(map(self.tokens.__getitem__, ids.tolist()))
        raw = b"".join(pieces)
        at, n, jumps = 0, len(pieces), iter(np.flatnonzero(~self.closed[ids]).tolist())
        while self.valid and at < n:
            if self.state == 0:
                at = next((j for j in jumps if j >= at), n)
                if at == n:
                    break
            self.state = self.machine.step(self.state, pieces[at])
            self.valid = self.state is not None
            at += 1
        text = self.held + raw
        cut = len(text)
        if self.valid and self.state:
            cut -= 1
            while text[cut] & 0xC0 == 0x80:
                cut -= 1
        self.held = text[cut:]
        return raw, text[:cut].decode("utf-8", "strict" if self.valid else "replace")

    def close(self) -> bool:
        """Whether the stream was UTF-8 and ended between characters."""
        done, self.held = self.valid and self.state == 0, b""
        return done


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> tuple[WordMemo, StreamDecoder]:
    ranks, split = read_ranks(ranks_path), regex.compile(pattern)
    transducer = Transducer(ranks)

    def pack(texts: list[str]) -> list[bytes]:
        matches = [split.findall(t) for t in texts]
        ids, counts = transducer.encode_many([m.encode() for found in matches for m in found])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, matches)])] * 4
        packed, ends = ids.astype("<u4").tobytes(), ends.tolist()
        return [packed[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    return WordMemo(pack), StreamDecoder(ranks)


def blocks(ids: np.ndarray, size: int = BLOCK_IDS) -> Iterable[np.ndarray]:
    return (ids[i : i + size] for i in range(0, len(ids), size))


def bpe_encode(df: DataFrame, text: str, ranks_path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Adds `out`: the ids of the column `text` as an array of integers."""
    schema = df.withColumn(out, F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, _ = coder(ranks_path, pattern)
        for batch in batches:
            packed = memo.encode_all(t or "" for t in batch.column(text).to_pylist())
            ids = [np.frombuffer(p, "<u4").astype("i4") for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids: str, ranks_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Adds `out`: the text of the array column `ids`, read block by block."""
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coder(ranks_path, pattern)
        for batch in batches:
            texts = []
            for row in batch.column(ids).to_pylist():
                decoder.restart()
                texts.append("".join(decoder.feed(b)[1] for b in blocks(np.array(row or [], "i8"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number and digest of its ids and the digest of the bytes
    that the decoder gives for those ids; no shuffle, a row in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, decoder = coder(ranks_path, pattern)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for packed in memo.encode_all(text.as_py() or "" for text in batch.column("text")):
                ids = np.frombuffer(packed, "<u4")
                decoder.restart()
                digest = hashlib.sha256()
                for block in blocks(ids):
                    digest.update(decoder.feed(block)[0])
                decoder.close()
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(packed).hexdigest())
                text_digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
