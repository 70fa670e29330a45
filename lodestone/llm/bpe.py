"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges define a nondeterministic transducer over bytes: a path reads one token after the other along the token
trie and writes it, and two tokens may follow each other only if they are compatible (the merges turn their bytes into
exactly these two). A token sequence is the merges' own result if and only if all its neighbours are compatible, so of
all paths that end a token at a place, one is right. The deterministic form is built on demand: its state is the set of
live trie paths, named by the longest (the others are its suffixes), and its transitions are found when first taken.
For each place it records the token with which the right path ends there. What all live paths agree on is written;
as a path is no longer than a token, the lookahead is bounded by the longest token.

Each match of the pre-tokenisation pattern is encoded by itself; a piece that is a token is that token.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_texts

#: Most token pairs and most pieces that one Python worker keeps; the caches start anew beyond them, which costs only time.
MOST_PAIRS, MOST_PIECES = 2_000_000, 400_000
#: Bytes of a piece after which the agreed tokens are written, and tokens of one step of decoding.
WRITE_EVERY, DECODE_EVERY = 4096, 16384
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_ROOT, _NO_MERGE = 0, 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 of the bytes, a space and the rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.child: list[dict[int, int]] = [{}]  # of a trie node, by byte
        self.above: list[tuple[int, int]] = [(_ROOT, -1)]  # its parent and byte
        token_at = {}
        for token, rank in ranks.items():
            node = _ROOT
            for b in token:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.above.append((node, b))
                node = self.child[node][b]
            token_at[node] = rank
        self.token_at = token_at
        self.next: dict[int, int] = {}  # deterministic transitions taken so far: state * 256 + byte
        self.shorter: dict[int, int] = {}  # the longest live path below the longest
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {_ROOT: ()}  # length and token of each live path that ends a token
        self.depth: dict[int, int] = {_ROOT: 0}
        self.fitting: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, bytes]]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, bytes]]:
        """What stands at the left (0) or right (-1) edge of the token while merges build it: rank of the merge, bytes. None if they don't build it."""
        if (known := self.spines.get((token, side))) is None:
            text = self.bytes[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            known = [(-1, parts[side])]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NO_MERGE), i) for i in range(len(parts) - 1))
                if rank == _NO_MERGE:
                    known = []
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if parts[side] != known[-1][1]:
                    known.append((rank, parts[side]))
            self.spines[token, side] = known
        return known

    def fits(self, last: int, token: int) -> bool:
        """Whether the merges leave the border between the two tokens alone: while both grow in the order of ranks, no merge across it comes first (of equal ranks, the one further left does)."""
        left, right = (self._spine(last, -1) if last >= 0 else [(-1, b"")]), self._spine(token, 0)
        if not left or not right:
            return False
        if last < 0:
            return True
        i = j = 0
        while True:
            grow_left = left[i + 1][0] if i + 1 < len(left) else _NO_MERGE
            grow_right = right[j + 1][0] if j + 1 < len(right) else _NO_MERGE
            across = self.ranks.get(left[i][1] + right[j][1], _NO_MERGE)
            if across < grow_left and across <= grow_right and across < _NO_MERGE:
                return False
            if grow_left == grow_right == _NO_MERGE:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _shorter(self, state: int) -> int:
        if (known := self.shorter.get(state)) is None:
            parent, b = self.above[state]
            known = self.shorter[state] = _ROOT if parent == _ROOT else self.move(self._shorter(parent), b)
        return known

    def move(self, state: int, b: int) -> int:
        key = state << 8 | b
        if (to := self.next.get(key)) is None:
            to = self.child[state].get(b)
            if to is None:
                to = _ROOT if state == _ROOT else self.move(self._shorter(state), b)
            self.next[key] = to
            if to not in self.ends:
                depth, node = 0, to
                while node != _ROOT:
                    depth, node = depth + 1, self.above[node][0]
                self.depth[to] = depth
                down, ends = to, []
                while down != _ROOT:
                    if (token := self.token_at.get(down)) is not None:
                        ends.append((len(self.bytes[token]), token))
                    down = self._shorter(down)
                self.ends[to] = tuple(ends)
        return to

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.fitting) > MOST_PAIRS:
            self.fitting.clear()
        following, ends, fitting = self.next, self.ends, self.fitting
        out: list[int] = []
        state, right, base = _ROOT, [-1], 0  # right: the right path's last token at each place from base on
        for i, b in enumerate(piece, 1):
            if (to := following.get(state << 8 | b)) is None:
                to = self.move(state, b)
            state = to
            for length, token in ends[state]:
                last = right[i - base - length]
                key = (last + 1) << 32 | token
                if (fit := fitting.get(key)) is None:
                    fit = fitting[key] = self.fits(last, token)
                if fit:
                    right.append(token)
                    break
            if i - base >= WRITE_EVERY:
                agreed = self._agreed(right, self.depth[state])
                out += self._path(right, agreed)
                right, base = right[agreed:], base + agreed
        return out + self._path(right, len(right) - 1)

    def _path(self, right: list[int], to: int) -> list[int]:
        path = []
        while to:
            path.append(right[to])
            to -= len(self.bytes[right[to]])
        return path[::-1]

    def _agreed(self, right: list[int], depth: int) -> int:
        """The last place that the paths to all places where the next token may begin have in common."""
        places = set(range(max(0, len(right) - 1 - depth), len(right)))
        while len(places) > 1:
            places.remove(far := max(places))
            places.add(far - len(self.bytes[right[far]]))
        return places.pop()


class Pieces(dict):
    """Packed token ids of pieces, made on demand."""

    def __init__(self, transducer: Transducer, dtype: np.dtype):
        super().__init__()
        self.transducer, self.dtype = transducer, dtype

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.transducer.encode(piece.encode()), self.dtype).tobytes()
        if len(piece) <= 64:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for whole texts."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.ranks = read_ranks(raw)
        self.transducer = Transducer(self.ranks)
        self.dtype = np.dtype("<u2" if max(self.ranks.values()) < 1 << 16 else "<u4")
        self.pieces = Pieces(self.transducer, self.dtype)
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.decimal = [str(i) for i in range(size)]
        self.token = [self.transducer.bytes.get(i, b"") for i in range(size)]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.find(text))), self.dtype)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode_stream(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text as the tokens arrive: an incremental UTF-8 state machine holds back the bytes of a character that is not whole yet; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield machine.decode(self.decode_bytes(ids))
        yield machine.decode(b"", final=True)


_codecs: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker, so that its automaton outlives a task."""
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with token_ids, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the bytes decoded from the ids).

    Null and empty texts have no tokens; bytes that are no UTF-8 count as U+FFFD; columns named as a result are replaced; repeated rows are encoded each; the path of the vocabulary file is read on
    the driver only. Nothing is shuffled, and whole texts are encoded whatever their length.
    """
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as file:
        raw = file.read()
    pattern = pattern or public_tokenizers.PATTERN
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def encode(texts: pa.Array, _: pa.RecordBatch) -> list:
        c = codec(shared.value, pattern)
        ids = [c.encode(t.decode("utf-8", "replace")) for t in texts.to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        named, decoded = [], []
        for x in ids:
            x = x.tolist()
            named.append(sha256(",".join(map(c.decimal.__getitem__, x)).encode()).hexdigest())
            back = sha256()
            for part in c.decode_stream(x[i : i + DECODE_EVERY] for i in range(0, len(x), DECODE_EVERY)):
                back.update(part.encode())
            decoded.append(back.hexdigest())
        flat = np.concatenate(ids) if ids else np.zeros(0, c.dtype)
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.astype(np.int32)))
        return [tokens, sizes, named, decoded]

    return map_texts(docs, encode, "token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", keep_text=keep_text)


def op5_byte_level_bpe(spark, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    return bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
