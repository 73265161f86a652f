"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as a small state machine.

A text is cut into pieces (words, single digits, runs of signs); merges never cross a piece.
Within a piece the transducer keeps a buffer of bytes. A token is *stable* once no further
input can change it: the merge list gives the number of bytes to the right of its start that
can matter (``lookahead``), so tokens that start at least that far before the end of the buffer are
given out and the rest is kept. Nothing crosses a token boundary, so encoding goes on from the
kept bytes alone, in constant memory for a piece of any length. A piece no longer than the lookahead
can only be encoded at its end; such pieces, nearly all, are encoded many at a time with numpy
and remembered in a table of bounded size.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

NONE = np.iinfo(np.int32).max
REMEMBERED = 300_000  # pieces kept in a task's table before it starts anew
AT_ONCE = 1 << 20  # characters of text whose pieces are looked up together
#: How the vocabulary file cuts text into pieces (its pre-tokenizer's pattern; white space as in its library).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t\n\x0B\f\r\x20\x85\p{Z}\p{L}\p{N}]+"""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else 256 and up in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list: pair lookup, byte symbols and the sufficient lookahead."""

    def __init__(self, tokens: list[str], pairs: list[tuple[int, int, int]], suffix: str, specials: dict[str, int]):
        self.tokens, self.suffix, self.specials = tokens, suffix, specials
        ids = {t: i for i, t in enumerate(tokens)}
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int32)
        self.last = np.array([ids[c + suffix] for c in alphabet], np.int32)
        self.pairs = np.array(pairs, np.int64).reshape(-1, 3)
        self._table()

    @classmethod
    def load(cls, path: str) -> Merges:
        """Read a tokenizer file whose decoder is empty and whose pieces are cut as ``PIECES`` says."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p]
        if spec["decoder"] is not None or len(patterns) != 1 or model["continuing_subword_prefix"]:
            raise ValueError(f"{path}: only byte-level merges with word ends, one pattern and no decoder are read")
        vocabulary = model["vocab"] | added
        tokens = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = token
        pairs = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append((vocabulary[a], vocabulary[b], vocabulary[a + b]))
        made: dict[int, int] = {}
        for rank, (a, b, new) in enumerate(pairs):
            if new in made or made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError(f"{path}: merge {rank} uses or repeats a token that is not made before it")
            made[new] = rank
        return cls(tokens, pairs, model["end_of_word_suffix"], added)

    def _table(self) -> None:
        """Open addressing: four times as many places as pairs, probed in order."""
        size = 1 << max(4, (4 * len(self.pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        self.made = np.zeros(size, np.int32)
        key = self.pairs[:, 0] << 32 | self.pairs[:, 1]
        home = self._home(key)
        left, self.probes = np.arange(len(key)), 0
        while len(left):
            place = (home[left] + self.probes) & self.mask
            free = self.keys[place] == -1
            order = np.unique(place[free], return_index=True)[1]
            won = left[free][order]
            at = (home[won] + self.probes) & self.mask
            self.keys[at], self.ranks[at], self.made[at] = key[won], won, self.pairs[won, 2]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.probes += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, new symbol) of pairs of symbols; rank ``NONE`` where no merge is listed."""
        key = a.astype(np.int64) << 32 | b
        home, place = self._home(key), np.zeros(len(key), np.int64)
        found = np.zeros(len(key), bool)
        for step in range(self.probes):
            at = (home + step) & self.mask
            hit = self.keys[at] == key
            place[hit], found = at[hit], found | hit
        return np.where(found, self.ranks[place], NONE), self.made[place]

    def lookahead(self) -> int:
        """Bytes from a token's start that can decide whether it is a token.

        A byte's symbol needs one byte more (is it the last?). Merge (a, b) happens only if b is
        there by then, so both a's end and the new token rest on what b rests on, len(a) further.
        Ranks only grow along such a chain, so one pass over the list finds the longest.
        """
        length = np.ones(len(self.tokens), np.int64)
        reach = np.full(len(self.tokens), 2, np.int64)
        for a, b, new in self.pairs.tolist():
            length[new] = length[a] + length[b]
            reach[a] = max(reach[a], length[a] + reach[b])
            reach[new] = max(reach[new], reach[a])
        return int(reach.max())

    def merge(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every piece ``symbols[bounds[i]:bounds[i + 1]]`` to its end; returns the same form.

        Each round applies to each piece its pair of lowest rank, at all its places from the left.
        """
        n = len(bounds) - 1
        piece = np.repeat(np.arange(n), np.diff(bounds))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        symbols = symbols.copy()
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            made = np.zeros(len(symbols), np.int32)
            inner = np.flatnonzero(piece[:-1] == piece[1:])
            rank[inner], made[inner] = self.rank(symbols[inner], symbols[inner + 1])
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(piece))))
            ready = best == NONE
            if ready.any():
                done.append((piece[ready], symbols[ready]))
                live = ~ready
                symbols, piece, rank, made, best = symbols[live], piece[live], rank[live], made[live], best[live]
            chosen = rank == best
            at = np.flatnonzero(chosen)
            if len(at):
                run = np.cumsum(np.diff(at, prepend=-2) != 1)  # neighbours share a symbol: every second one merges
                place = np.arange(len(at)) - np.flatnonzero(np.diff(run, prepend=0))[run - 1]
                at = at[place % 2 == 0]
                symbols[at] = made[at]
                keep = np.ones(len(symbols), bool)
                keep[at + 1] = False
                symbols, piece = symbols[keep], piece[keep]
        piece = np.concatenate([p for p, _ in done]) if done else np.zeros(0, np.int64)
        tokens = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
        order = np.argsort(piece, kind="stable")
        out = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(piece, minlength=n), out=out[1:])
        return tokens[order], out


class Transducer:
    """Encodes one piece fed in parts: ``feed`` gives out stable tokens, ``finish`` the rest."""

    def __init__(self, merges: Merges, lookahead: int, part: int = 8192):
        self.merges, self.lookahead, self.part = merges, lookahead, part
        self.buffer = b""

    def feed(self, data: bytes) -> Iterator[np.ndarray]:
        for start in range(0, len(data), self.part):
            self.buffer += data[start: start + self.part]
            if len(self.buffer) > self.lookahead:
                tokens = self._tokens(ended=False)
                ends = np.cumsum([self.length(t) for t in tokens.tolist()])
                stable = int(np.searchsorted(ends[:-1], len(self.buffer) - self.lookahead, "right"))
                if stable:
                    self.buffer = self.buffer[int(ends[stable - 1]):]
                    yield tokens[:stable]

    def finish(self) -> np.ndarray:
        tokens = self._tokens(ended=True) if self.buffer else np.zeros(0, np.int32)
        self.buffer = b""
        return tokens

    def length(self, token: int) -> int:
        return len(self.merges.tokens[token].removesuffix(self.merges.suffix))

    def _tokens(self, ended: bool) -> np.ndarray:
        raw = np.frombuffer(self.buffer, np.uint8)
        symbols = self.merges.inner[raw]
        if ended:
            symbols[-1] = self.merges.last[raw[-1]]
        return self.merges.merge(symbols, np.array([0, len(symbols)]))[0]


class Decoder:
    """Ids to text as they come: a vocabulary without decoder writes its tokens with a blank between two."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.begun = tokens, False

    def feed(self, ids: list[int]) -> str:
        text = " ".join(map(self.tokens.__getitem__, ids))
        if self.begun and ids:
            text = " " + text
        self.begun |= bool(ids)
        return text


class Encoder:
    """Texts to ids with a table of pieces met before."""

    def __init__(self, merges: Merges):
        self.merges, self.lookahead = merges, merges.lookahead()
        self.known: dict[str, bytes] = {}
        self.pattern = regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pieces of a text in order; a special token's string is its id."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.cut(text[at: m.start()])
            yield self.merges.specials[m.group()]
            at = m.end()
        yield from self.cut(text[at:] if at else text)

    def cut(self, text: str) -> list[str]:
        """Composed, lower-cased letter by letter (so without a final form of sigma), then cut."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not in the table yet: all short ones at once."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        coded = [p.encode() for p in new]
        short = [i for i, c in enumerate(coded) if len(c) <= self.lookahead]
        if short:
            sizes = np.array([len(coded[i]) for i in short])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            raw = np.frombuffer(b"".join(coded[i] for i in short), np.uint8)
            symbols = self.merges.inner[raw]
            symbols[bounds[1:] - 1] = self.merges.last[raw[bounds[1:] - 1]]
            tokens, out = self.merges.merge(symbols, bounds)
            whole, out = tokens.astype("<u4").tobytes(), (4 * out).tolist()
            for k, i in enumerate(short):
                self.known[new[i]] = whole[out[k]: out[k + 1]]

    def stream(self, piece: str) -> bytes:
        """A piece longer than the lookahead."""
        machine = Transducer(self.merges, self.lookahead)
        return b"".join(t.astype("<u4").tobytes() for t in [*machine.feed(piece.encode()), machine.finish()])

    def ids(self, pieces: list[str | int]) -> bytes:
        """Ids of pieces as little-endian 32-bit numbers."""
        known = self.known
        return b"".join([known[p] if p in known else self.stream(p) if isinstance(p, str) else p.to_bytes(4, "little") for p in pieces])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; pieces are looked up together for many short texts, in runs for a long one."""
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= AT_ONCE:
                size += len(texts[to])
                to += 1
            if size <= AT_ONCE:
                cut = [list(self.pieces(t)) for t in texts[at:to]]
                self.learn({p for c in cut for p in c if isinstance(p, str)})
                yield from map(self.ids, cut)
            else:
                out, rest = [], self.pieces(texts[at])
                while part := list(islice(rest, 1 << 17)):
                    self.learn({p for p in part if isinstance(p, str)})
                    out.append(self.ids(part))
                yield b"".join(out)
            at = to


def coder(spec: Callable, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the text in the last column to their first ``kept`` columns and n_tokens, ids, decoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(*spec.value)
        encoder = Encoder(merges)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, counts, texts = [], [], []
                for coded in encoder.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()]):
                    ids.append(coded)
                    counts.append(len(coded) // 4)
                    decoder, numbers = Decoder(merges.tokens), np.frombuffer(coded, "<u4")
                    texts.append("".join(decoder.feed(numbers[i: i + 65536].tolist()) for i in range(0, len(numbers), 65536)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                    [*part.schema.names[:kept], "n_tokens", "ids", "decoded"])
    return run


def encode(docs: DataFrame, path: str, kept: list[str] = ["doc_id"]) -> DataFrame:
    """Encode and decode ``docs`` (text): columns ``kept``, n_tokens, ids (binary, 32-bit little-endian), decoded.

    ``path`` is the tokenizer file on the driver; its tables (a few MB, fixed by the vocabulary) are
    broadcast. One row per row; null and empty texts have no tokens and decode to ''. Kept columns stay as they
    are, nulls too; they may not be named like the new ones. No rows give no rows. No shuffle.
    """
    m = Merges.load(path)
    spec = docs.sparkSession.sparkContext.broadcast((m.tokens, m.pairs.tolist(), m.suffix, m.specials))
    new = [StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())]
    schema = StructType([*docs.select(*kept).schema.fields, *new])
    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(coder(spec, len(kept)), schema)
