"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut where a non-space is followed by a space (no piece of such a model crosses that
boundary), equal words of a batch are encoded once, and all words together live in flat numpy arrays:
one symbol number per character, one range per word. A round finds the best pair of each word
(segmented minimum of pair ranks), merges all its occurrences in the word from the left at once and
compacts the arrays; words without a pair leave. Where a merged symbol would at once form a pair that
is as good or better with a neighbour, the word merges only its leftmost occurrence in that round, which
is the order in which the library works, so results are the library's own.

Symbols left over that are no pieces become byte pieces. A null text is the empty one (no ids). The
model file is a parameter; executors load it once per Python process.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_all_columns

SPACE = "▁"
NO_RANK = np.int64(1) << 40
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words that a process remembers between batches; the rest are encoded again.
REMEMBERED = 200_000


class Model:
    """Pieces of a BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, proto.SentencePiece
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and proto.trainer_spec.byte_fallback):
            raise ValueError("only BPE models with byte fallback, an identity normaliser and a dummy prefix are read")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for _, piece, _ in normal):
            raise ValueError("a piece crosses a word boundary")
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.ids = {piece: i for i, piece, _ in normal}
        steps = {s: r for r, s in enumerate(sorted({s for *_, s in normal}, reverse=True))}
        self.size = len(proto.pieces)
        self.rank = np.full(self.size, NO_RANK)
        for i, _, s in normal:
            self.rank[i] = steps[s]
        # Every way to write a piece as two symbols. Single characters that are no pieces never merge.
        symbols: dict[str, int] = dict(self.ids)
        pairs: dict[int, int] = {}
        for i, piece, _ in normal:
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is None and k == 1:
                    a = symbols[piece[:1]] = self.size + len(symbols)
                if b is None and k == len(piece) - 1:
                    b = symbols[piece[k:]] = self.size + len(symbols)
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.characters = {s: i for s, i in symbols.items() if len(s) == 1}
        keys = np.array(sorted(pairs), np.int64)
        self._pairs(keys, np.array([pairs[k] for k in keys.tolist()], np.int64))
        texts = [b""] * self.size
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                texts[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                texts[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                texts[i] = proto.trainer_spec.unk_surface.encode()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[list(self.bytes.values())] = True
        self.leads = np.array([t[:1] == b" " and proto.pieces[i].type == kinds.NORMAL for i, t in enumerate(texts)])
        self.remembered: dict[str, bytes] = {}

    def _pairs(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        """An open hash table of pairs: two gathers a lookup, no search."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        size = 1 << bits
        self.table, self.made = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.table[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            self.table[slot[take]], self.made[slot[take]] = keys[todo[take]], pieces[todo[take]]
            todo, slot = todo[~take], (slot[~take] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make together, or -1."""
        keys = (left << 32) | right
        out = np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.table[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.made[slot[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) % len(self.table)
        return out

    def _rank_of(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank[piece], NO_RANK)

    def rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left. symbols: of all words in a row; word: the word of each, ascending."""
        done_symbols, done_words, done_at = [], [], []
        at = np.arange(len(symbols))  # where a symbol began; keeps the order of symbols
        while len(symbols):
            pair = np.full(len(symbols), -1, np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair[inner] = self.merged(symbols[inner], symbols[inner + 1])
            rank = self._rank_of(pair)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(heads, len(word)))
            best = np.minimum.reduceat(rank, heads)
            active = best < NO_RANK
            if not active.all():
                out = np.repeat(~active, lengths)
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                done_at.append(at[out])
                symbols, word, at, pair, rank = symbols[~out], word[~out], at[~out], pair[~out], rank[~out]
                lengths, best = lengths[active], best[active]
                if not len(symbols):
                    break
                heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            least = np.repeat(best, lengths)
            hit = np.flatnonzero(rank == least)
            # Occurrences that touch: of a run of overlapping ones every second merges, from the left.
            start = np.concatenate([[True], np.diff(hit) != 1])
            begin = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            piece = pair[hit]
            segment = np.repeat(np.arange(len(heads)), lengths)
            owner = segment[hit]
            # Words where the merge could open a pair as good as the one being merged go one step at a time.
            several = np.bincount(owner, minlength=len(heads))[owner] > 1
            if several.any():
                h, p, own, r = hit[several], piece[several], owner[several], least[hit[several]]
                left, right = np.maximum(h - 1, 0), np.minimum(h + 2, len(symbols) - 1)
                has_left, has_right = (h > 0) & (segment[left] == own), (h + 2 < len(symbols)) & (segment[right] == own)
                risky = has_left & (self._rank_of(self.merged(symbols[left], p)) <= r)
                risky |= has_right & (self._rank_of(self.merged(p, symbols[right])) <= r)
                prev = np.searchsorted(hit, h - 2)
                joined = (prev < len(hit)) & (hit[np.minimum(prev, len(hit) - 1)] == h - 2) & has_left
                risky |= joined & (self._rank_of(self.merged(p, p)) <= r)
                if risky.any():
                    single = np.zeros(len(heads), bool)
                    single[own[risky]] = True
                    first = np.zeros(len(hit), bool)
                    first[np.unique(owner, return_index=True)[1]] = True
                    stay = first | ~single[owner]
                    hit, piece = hit[stay], piece[stay]
            symbols = symbols.copy()
            symbols[hit] = piece
            alive = np.ones(len(symbols), bool)
            alive[hit + 1] = False
            symbols, word, at = symbols[alive], word[alive], at[alive]
        if not done_symbols:
            return symbols, word
        symbols, word, at = np.concatenate(done_symbols), np.concatenate(done_words), np.concatenate(done_at)
        order = np.argsort(at)
        return symbols[order], word[order]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words are spelled with the space symbol."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        fresh = 1 << 31  # stands for characters that are no symbol: 2**31 + code point, which is in no pair
        known = np.array([self.characters.get(chr(c), fresh + c) for c in distinct.tolist()], np.int64)
        symbols = known[inverse] if len(points) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, word = self.rounds(symbols, word)
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            spell = {i: s for s, i in self.characters.items() if i >= self.size}
            tails = [[self.bytes[b] for b in (spell.get(s) or chr(s - fresh)).encode("utf-8", "surrogatepass")] for s in symbols[odd].tolist()]
            counts = np.ones(len(symbols), np.int64)
            counts[odd] = [len(t) for t in tails]
            to = np.concatenate([[0], np.cumsum(counts)])
            full = np.repeat(symbols, counts)
            for i, t in zip(odd.tolist(), tails, strict=True):
                full[to[i] : to[i] + len(t)] = t
            symbols, word = full, np.repeat(word, counts)
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        return [symbols[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as int32 arrays."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        memory = self.remembered
        new = list({w for words in split for w in words if w not in memory})
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = list({w for words in split for w in words})
        at = 0
        while at < len(new):
            size, end = 0, at
            while end < len(new) and (size < 400_000 or end == at):
                size += len(new[end])
                end += 1
            for w, ids in zip(new[at:end], self.encode_words(new[at:end]), strict=True):
                memory[w] = ids.astype(np.int32).tobytes()
            at = end
        return [np.frombuffer(b"".join([memory[w] for w in words]), np.int32) for words in split]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8. Of a run of byte pieces that is no UTF-8, each bad byte becomes U+FFFD."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        if not total:
            return b""
        where = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        raw = self.flat[where + np.arange(total)].tobytes()
        if self.leads[ids[np.argmax(lengths > 0)]]:
            raw = raw[1:]
        if self.is_byte[ids].any():
            if not lengths.all():  # a control piece leaves no trace but ends a run of bytes
                return self._decode_odd(ids)
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = self._decode_odd(ids)
        return raw

    def _decode_odd(self, ids: np.ndarray) -> bytes:
        out, run = [], bytearray()

        def flush() -> None:
            while run:
                for k in (4, 3, 2, 1):
                    try:
                        if len(run) >= k and len(bytes(run[:k]).decode()) == 1:
                            out.append(bytes(run[:k]))
                            del run[:k]
                            break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    del run[:1]

        first = int(np.argmax(self.lengths[ids] > 0))
        for n, i in enumerate(ids.tolist()):
            piece = self.flat[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()
            if self.is_byte[i]:
                run += piece
            else:
                flush()
                out.append(piece[1:] if n == first and self.leads[i] else piece)
        flush()
        return b"".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of ids (array of int); a column of that name is replaced."""
    rest = df.drop(ids)
    at = rest.columns.index(text)

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in _parts(batch, at):
                made = own.encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(made)], [*part.schema.names, "made"])

    return map_all_columns(rest, on_batches, T.ArrayType(T.IntegerType()), ids)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column of the text that the ids stand for (null for null ids)."""
    rest = df.drop(text)
    at = rest.columns.index(ids)

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            made = [None if x is None else own.decode_bytes(np.array(x, np.int64)).decode() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "made"])

    return map_all_columns(rest, on_batches, T.StringType(), text)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _parts(batch: pa.RecordBatch, at: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of bounded text."""
    sizes = np.cumsum(np.array([x or 0 for x in pa.compute.binary_length(batch.column(at)).to_pylist()], np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def digests(df: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row of df (doc_id, text)."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        digits = np.array([str(i) for i in range(own.size)], object)
        for batch in batches:
            for part in _parts(batch, batch.schema.get_field_index("text")):
                encoded = own.encode(column(part, "text").to_pylist())
                written = [hashlib.sha256(",".join(digits[x].tolist()).encode()).hexdigest() for x in encoded]
                decoded = [hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in encoded]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(x) for x in encoded], pa.int64()), pa.array(written), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(on_batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
