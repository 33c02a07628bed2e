"""SentencePiece encoding and decoding by one pass of an Aho-Corasick automaton.

The automaton runs over the UTF-8 bytes of a text; at each position the output
links list every piece that ends there, and each relaxes the best score of
that position. Positions of many units are stepped together as numpy arrays;
a very long unit (a run without blanks) goes by plain numbers, in linear time.

No piece has the space mark after another character, so the best path of a
text is the best paths of its units (a run of space marks and what follows up
to the next one), one after the other; equal units are solved once.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelens.llm.common import one, read
from slicelens.llm.registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNIT = re.compile(r" *[^ \n]+| +|\n+")
#: Below the worst piece: what a byte outside all pieces costs more.
PENALTY = 10.0
#: Bytes stepped together; bytes of solved units that a worker keeps.
TOGETHER, KEPT = 1 << 18, 1 << 21
#: Units of more characters are stepped alone, by plain numbers: arrays of one element cost more.
LONG = 2048
#: Texts encoded together.
TEXTS = 128


class Packed:
    """Numbered runs of values in one array."""

    def __init__(self):
        self.values, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values = np.concatenate((self.values.astype(values.dtype), values))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of some numbers, one after the other, and where each ends."""
        starts = self.ends[numbers]
        lengths = self.ends[numbers + 1] - starts
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.values[at + np.repeat(starts - ends + lengths, lengths)], ends


class Pieces:
    """Vocabulary, automaton, encoder and decoder.

    ``pieces`` are the texts by id, with ``▁`` for a space (None: an id never
    produced); ``bytes_from`` is the id of byte 0, the others follow it. The
    score of a piece falls with its id as in a vocabulary sorted by frequency:
    minus the log of its rank.
    """

    def __init__(self, pieces: list[str | None], bytes_from: int):
        self.pieces, self.bytes_from = pieces, bytes_from
        self.raw = [None if p is None else p.replace(SPACE, " ").encode() for p in pieces]
        if any(r and (b" " in r.lstrip(b" ") or b"\n" in r) for r in self.raw):
            raise ValueError("a piece crosses units")
        self.score = -np.log(np.arange(len(pieces), dtype=np.float64) + 2)
        self.byte_score = float(self.score.min()) - PENALTY
        self.length = np.array([len(r or b"") for r in self.raw])
        self._build()
        self._forget()
        table = [r or b"" for r in self.raw]
        table[bytes_from : bytes_from + 256] = [bytes([b]) for b in range(256)]
        self.spelt = Packed()
        self.spelt.add(np.frombuffer(b"".join(table), np.uint8), np.array([len(t) for t in table]))

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.solved, self.held = Packed(), 0

    def _build(self) -> None:
        children: list[dict[int, int]] = [{}]
        depth_of = [0]
        ends: dict[int, int] = {}
        for i, raw in enumerate(self.raw):
            if not raw or self.bytes_from <= i < self.bytes_from + 256:
                continue
            node = 0
            for byte in raw:
                following = children[node].get(byte)
                if following is None:
                    following = children[node][byte] = len(children)
                    children.append({})
                    depth_of.append(depth_of[node] + 1)
                node = following
            ends.setdefault(node, i)
        n = len(children)
        self.goto = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)
        fail = np.zeros(n, np.int32)
        self.piece = np.full(n, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        #: The nearest state down the failure links that ends a piece; 0 is none.
        self.output = np.zeros(n, np.int32)
        queue = [0]
        for node in queue:
            row = self.goto[fail[node]].copy() if node else self.goto[0]
            for byte, child in children[node].items():
                fail[child] = row[byte] if node else 0
                row[byte] = child
                queue.append(child)
            self.goto[node] = row
            if node:
                f = fail[node]
                self.output[node] = f if self.piece[f] >= 0 else self.output[f]

    def _solve(self, units: list[str]) -> None:
        """Viterbi over all units at once, one byte position a step."""
        units = sorted(units, key=lambda u: -len(u.encode()))
        raw = [u.encode() for u in units]
        size = np.array([len(r) for r in raw])
        width = int(size[0])
        data = np.zeros((len(raw), width), np.uint8)
        data[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        best = np.full((width + 1, len(raw)), -np.inf)
        best[0] = 0
        via = np.zeros((width + 1, len(raw)), np.int32)
        state = np.zeros(len(raw), np.int32)
        for at in range(width):
            n = int(np.searchsorted(-size, -at))  # units longer than `at`
            byte = data[:n, at]
            state = self.goto[state[:n], byte].astype(np.int32)
            top = best[at, :n] + self.byte_score
            token = self.bytes_from + byte.astype(np.int32)
            link = np.where(self.piece[state] >= 0, state, self.output[state])
            live = np.flatnonzero(link)
            while len(live):
                piece = self.piece[link[live]]
                score = best[at + 1 - self.length[piece], live] + self.score[piece]
                better = score > top[live]
                won = live[better]
                top[won], token[won] = score[better], piece[better]
                link[live] = self.output[link[live]]
                live = live[link[live] > 0]
            best[at + 1, :n], via[at + 1, :n] = top, token
        # All paths are walked back together, last token first.
        lengths = np.where((np.arange(len(self.raw)) >= self.bytes_from)
                           & (np.arange(len(self.raw)) < self.bytes_from + 256), 1, self.length)
        at, live, back = size.copy(), np.arange(len(raw)), []
        owner = []
        while len(live):
            token = via[at[live], live]
            back.append(token)
            owner.append(live)
            at[live] -= lengths[token]
            live = live[at[live] > 0]
        token, owner = np.concatenate(back)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        self._keep(units, token[order].astype(np.int32), np.bincount(owner, minlength=len(raw)))
        self.held += int(size.sum())

    def _keep(self, units: list[str], tokens: np.ndarray, lengths: np.ndarray) -> None:
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.solved.add(tokens, lengths)

    @functools.cached_property
    def _plain(self) -> tuple:
        """The tables of ``_solve_long``: transitions, first output, next output, length and score."""
        first = np.where(self.piece >= 0, np.arange(len(self.piece), dtype=np.int32), self.output)
        ends = np.maximum(self.piece, 0)
        return (memoryview(self.goto.reshape(-1)), first.tolist(), self.output.tolist(), self.piece.tolist(),
                self.length[ends].tolist(), self.score[ends].tolist())

    def _solve_long(self, unit: str) -> None:
        """The same relaxations as ``_solve``, for one unit; a few microseconds a byte."""
        goto, first, output, piece, length, score = self._plain
        raw, penalty, base = unit.encode(), self.byte_score, self.bytes_from
        best, via, state, end = [0.0] * (len(raw) + 1), np.zeros(len(raw) + 1, np.int32), 0, 0
        chosen = memoryview(via)
        for byte in raw:
            state = goto[state << 8 | byte]
            top, token, link = best[end] + penalty, base + byte, first[state]
            end += 1
            while link:
                value = best[end - length[link]] + score[link]
                if value > top:
                    top, token = value, piece[link]
                link = output[link]
            best[end], chosen[end] = top, token
        tokens = []
        while end:
            token = chosen[end]
            tokens.append(token)
            end -= 1 if base <= token < base + 256 else int(self.length[token])
        self._keep([unit], np.array(tokens[::-1], np.int32), np.array([len(tokens)]))
        self.held += len(raw)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the text is taken as if a space stood before it.

        ``▁`` itself never matches a piece's space mark: its bytes are not the
        byte of a space, so it becomes three byte ids.
        """
        if not texts:
            return []
        if self.held > KEPT:
            self._forget()
        cut = [_UNIT.findall(" " + t) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        group: list[str] = []
        for unit in sorted(set(flat).difference(self.number), key=len):
            if len(unit) > LONG:
                self._solve_long(unit)
                continue
            group.append(unit)
            if len(unit) * len(group) > TOGETHER:
                self._solve(group)
                group = []
        if group:
            self._solve(group)
        number = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        ids, ends = self.solved.take(number)
        return np.split(ids, np.append(0, ends)[np.cumsum([len(c) for c in cut])[:-1]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; the space before it goes. Wrong UTF-8 in bytes is replaced."""
        raw, _ = self.spelt.take(np.asarray(ids, np.int64))
        return raw[1:].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    first = next(i for i in ids if model.is_byte(i))
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
    return Pieces(
        [None if special[i] else model.id_to_piece(i) for i in ids], first
    )


def encoded(text: Column, path: str = MODEL) -> Column:
    """Ids of every whole text (empty for null or empty)."""

    @F.pandas_udf("array<int>")
    def encode(column: pd.Series) -> pd.Series:
        coder, out = load(path), []
        texts = [t or "" for t in column]
        for lo in range(0, len(texts), TEXTS):
            out += coder.encode(texts[lo : lo + TEXTS])
        return pd.Series(out, dtype=object)

    return encode(text)


def decoded(ids: Column, path: str = MODEL) -> Column:
    """Text of every list of ids; null stays null."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        coder = load(path)
        return pd.Series([None if i is None else coder.decode(i) for i in column], dtype=object)

    return decode(ids)


def encode_checked(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, ids, n_tokens, restored``: every document's ids and whether they decode to its text.

    Needs ``doc_id, text``; a null text counts as empty and has no ids. One
    Python pass encodes and decodes, so no text crosses twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(path)
        for batch in batches:
            for lo in range(0, len(batch), TEXTS):
                part = batch.iloc[lo : lo + TEXTS]
                texts = [t or "" for t in part.text]
                ids = coder.encode(texts)
                yield pd.DataFrame({
                    "doc_id": part.doc_id, "ids": ids,
                    "n_tokens": [len(i) for i in ids],
                    "restored": [coder.decode(i) == t for i, t in zip(ids, texts, strict=True)],
                })

    plain = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = plain.mapInPandas(one(run), "doc_id string, ids array<int>, n_tokens long, restored boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


@query("op9_sentencepiece")
def op9_sentencepiece(spark, folder):
    """Every document's piece ids, with the proof that they decode to its text."""
    return encode_checked(read(spark, folder, "documents"))
