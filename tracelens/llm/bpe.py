"""Byte-level BPE as a lazily determinised transducer, and decoding as a UTF-8 state machine.

Encoding. Every prefix of a string has one encoding, and its last token is the only token that ends
there, begins where another prefix ends and keeps its boundary to that prefix's last token. The tokens
under way are a trie's nodes, one for each place where one can have begun; all are suffixes of the longest, which
therefore stands for the set. Reading a byte moves the set down the trie and opens a new token; moves are made when
first met and kept, up to a bound, with the tokens that end behind them. The one that keeps its boundary is
the last token of the longer prefix; if no longer one does, it is the shortest. Tokens are emitted once all that are under way
go back through their end, which takes a lookahead bounded by the longest token in practice.

Two tokens keep their boundary if no merge across it comes before the merges that built them: their
inner edges are taken apart, later merge first, and each pair that faces the other is looked up.

Decoding joins the bytes of ids; a state machine holds back the bytes of an unfinished character.

Defined cases: null and empty texts give no tokens and the digest of no bytes; repeated rows and
ids give a row each; other columns are left out and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import claim, settle
from .pretokens import KINDS, Splitter
from .textnum import blocks, buffer
from .token_files import WORD, cuts, gather

#: What a worker keeps: moves, boundaries and words; pieces, twice as many with those of the time before.
MOVES, WORDS, PIECES = 400_000, 50_000, 200_000
#: Bytes of texts that are cut and encoded together, and bytes read between two looks at what can be emitted.
AT_ONCE, READ = 4 << 20, 512
#: (token, length) pairs.
Ends = tuple[tuple[int, int], ...]


class MergeTransducer:
    """Encodes byte strings by ranks; ids are ranks and rank order is merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        # a trie in one dict: node * 256 + byte -> node; the token, depth and longest proper suffix of a node
        self.child: dict[int, int] = {}
        self.token, self.depth, above = [-1], [0], [0]
        for token, i in ranks.items():
            node = 0
            for b in token:
                at = node * 256 + b
                node = self.child.get(at, 0)
                if not node:
                    node = self.child[at] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[at // 256] + 1)
                    above.append(at)
            self.token[node] = i
        self.suffix = [0] * len(self.token)
        #: The tokens that end at a node with their lengths, longest first.
        self.ends: list[Ends] = [()] * len(self.token)
        for node in sorted(range(1, len(self.token)), key=self.depth.__getitem__):
            up, b = divmod(above[node], 256)
            if up:
                self.suffix[node] = self._down(self.suffix[up], b)
            own = ((self.token[node], self.depth[node]),) if self.token[node] >= 0 else ()
            self.ends[node] = own + self.ends[self.suffix[node]]
        self.halves: dict[int, tuple[int, int]] = {}
        self.keeps: dict[int, bool] = {}
        self.moves: dict[int, tuple[int, Ends, int]] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if len(self.bytes[token]) == 1:
            return None
        if token not in self.halves:
            parts = [self.bytes[token][i:i + 1] for i in range(len(self.bytes[token]))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.bytes)))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return self.halves[token]

    def keep_boundary(self, left: int, right: int) -> bool:
        """True if the encoding of both tokens' bytes together is the two tokens; -1 is the begin."""
        key = left * len(self.bytes) + right
        if key not in self.keeps:
            if len(self.keeps) > MOVES:
                self.keeps.clear()
            self.keeps[key] = left < 0 or self._apart(left, right)
        return self.keeps[key]

    def _apart(self, x: int, y: int) -> bool:
        before = len(self.bytes)  # a merge across must come before this rank to happen
        while True:
            if self.ranks.get(self.bytes[x] + self.bytes[y], before) < before:
                return False
            a, b = self._split(x), self._split(y)
            if a is None and b is None:
                return True
            # the half that was merged last is undone; at equal ranks the right one, as merges go left to right
            if b is None or (a is not None and x > y):
                before, x = x, a[1]
            else:
                before, y = y + 1, b[0]

    def _down(self, node: int, b: int) -> int:
        """The longest token under way after a byte."""
        while not (down := self.child.get(node * 256 + b)) and node:
            node = self.suffix[node]
        return down or 0

    def _move(self, at: int) -> tuple[int, Ends, int]:
        """256 times the next node, the tokens that can end there but the shortest, and the shortest."""
        if len(self.moves) > MOVES:
            self.moves.clear()
        node = self._down(*divmod(at, 256))
        if not self.ends[node]:
            raise ValueError(f"byte {at % 256} is not in the vocabulary")
        *longer, (shortest, _) = self.ends[node]
        self.moves[at] = node * 256, tuple(longer), shortest
        return self.moves[at]

    def encode(self, data: bytes) -> list[int]:
        """Token ids of a byte string, emitted while it is read."""
        out: list[int] = []
        state, lasts = 0, [-1]  # lasts: the last token of each prefix since the place up to which all is emitted
        move, keeps, many = self.moves.get, self.keeps.get, len(self.bytes)
        for i in range(0, len(data), READ):
            if i and (settled := self._settled(state // 256, lasts)):
                out += self._back(lasts, settled)
                del lasts[:settled]
            for b in data[i:i + READ]:
                state, longer, last = move(state + b) or self._move(state + b)
                for token, n in longer:
                    kept = keeps(lasts[-n] * many + token)
                    if kept or kept is None and self.keep_boundary(lasts[-n], token):
                        last = token
                        break
                lasts.append(last)
        return out + self._back(lasts, len(lasts) - 1)

    def _back(self, lasts: list[int], end: int) -> list[int]:
        found = []
        while end > 0:
            found.append(lasts[end])
            end -= len(self.bytes[lasts[end]])
        return found[::-1]

    def _settled(self, node: int, lasts: list[int]) -> int:
        """The last place through which the encodings under way all go."""
        n = len(lasts) - 1
        places = {n}
        while node:
            places.add(n - self.depth[node])
            node = self.suffix[node]
        while len(places) > 1:
            far = max(places)
            places.remove(far)
            places.add(far - len(self.bytes[lasts[far]]))
        return places.pop()


class Utf8Stream:
    """Bytes in, whole characters out; what is unfinished waits for the next bytes."""

    #: After a lead byte: how many continuation bytes belong to it (0x80-0xBF lead nothing).
    NEEDS = bytes([0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11)

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[-back]
            if b < 0x80 or b >= 0xC0:
                if self.NEEDS[b] >= back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def library_class():
    """The class of a character as the tiktoken library sees it."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    kinds = {k: tiktoken.Encoding(f"class {k}", pat_str=p, mergeable_ranks=single, special_tokens={}) for k, p in KINDS.items()}
    return lambda c: next((k for k, e in kinds.items() if e.encode_ordinary(c)), "O")


class Codec:
    """Texts to packed ids and back, with caches of words and of pieces between safe cuts."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fst = MergeTransducer(ranks)
        self.splitter = Splitter(public_tokenizers.PATTERN, library_class())
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                data = word.encode("utf-8")
                packed = outer.pieces[data] if WORD.fullmatch(data) else outer._pack(data)
                if len(self) >= WORDS:
                    self.clear()
                if len(word) <= 256:
                    self[word] = packed
                return packed

        class Pieces(dict):
            def __missing__(self, piece: bytes) -> bytes:
                packed = self.earlier.get(piece)
                if packed is None:
                    packed = outer._pack(piece) if WORD.fullmatch(piece) else outer.encode(piece.decode("utf-8"))
                if len(self) >= PIECES:  # go on with what comes again
                    self.earlier = dict(self)
                    self.clear()
                if len(piece) <= 256:
                    self[piece] = packed
                return packed

        self.words, self.pieces = Words(), Pieces()
        self.pieces.earlier = {}

    def _pack(self, word: bytes) -> bytes:
        ids = self.fst.encode(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return b"".join(b"".join(map(self.words.__getitem__, p)) for p in self.splitter.pieces(text))

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The packed ids of each text of a buffer.

        Texts are cut where the pattern's cuts don't depend on what is before; each distinct piece of some megabytes is looked up once.
        """
        for i, j in blocks(offsets, AT_ONCE):
            part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            if len(part) > 2 * AT_ONCE:  # one text
                yield self.encode(part.tobytes().decode("utf-8"))
                continue
            begin = cuts(part, at)
            begin = begin[np.diff(begin, append=len(part)) > 0]  # empty texts have no piece
            places = pa.py_buffer(np.append(begin, len(part)).astype(np.int64))
            coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, places, pa.py_buffer(part.tobytes())]).dictionary_encode()
            packed = list(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
            where = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)))
            ids, lengths = gather(np.frombuffer(b"".join(packed), "<u4"), where, coded.indices.to_numpy(zero_copy_only=False))
            upto = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(begin, at)].tolist()
            for k, m in pairwise(upto):
                yield ids[k:m].tobytes()

    def decode(self, packed: bytes, step: int = 1 << 16):
        """The text of packed ids in parts of whole characters."""
        machine, tokens = Utf8Stream(), self.fst.bytes
        ids = np.frombuffer(packed, "<u4")
        for i in range(0, len(ids), step):
            yield machine.feed(b"".join([tokens[x] for x in ids[i:i + step].tolist()]))
        yield machine.close()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker and vocabulary."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and the packed ids if asked for."""
    def encode(batches):
        claim("bpe", codec.cache_clear)
        own = codec(path)
        for batch in batches:
            count, ids_sha, text_sha, kept = [], [], [], []
            for packed in own.encode_all(*buffer(batch.column(1))):
                digest = hashlib.sha256()
                for part in own.decode(packed):
                    digest.update(part.encode("utf-8"))
                count.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(digest.hexdigest())
                kept.append(packed if with_ids else None)
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = slim.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out if with_ids else out.drop("ids")
