"""Encode texts with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

For each prefix of a piece of text exactly one token can be the last of its BPE encoding. It is the one
vocabulary entry among those that end there (found by an automaton over all entries) that leaves a prefix
whose own last token is compatible with it: a pair is compatible if BPE applied to the two tokens'
bytes gives back just these two. Following the stored last tokens backwards yields the ids.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lines import chunks
from quire.runtime import ship, spread

#: Distinct pieces whose ids a Python worker remembers. Memory only: a piece beyond it is encoded anew.
MEMO = 400_000
_MADE: dict[str, "ByteBpe"] = {}


def default_path() -> str:
    """Where the installed vocabulary byte_bpe_50k lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by the format's rule:
    printable Latin-1 bytes stand for themselves, the others are numbered from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary whose ids grow in the order of its merges."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pieces = regex.compile(pattern).findall
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        entries: dict[int, bytes] = {vocab[c]: bytes([b]) for c, b in letters.items()}
        #: The age of a token: bytes first, then the merges in order. Ids need not follow it.
        self.age = {i: -1 for i in entries}
        for n, (a, b) in enumerate(merges):
            c = vocab[a + b]
            self.joined[vocab[a], vocab[b]] = n
            if c not in self.age:
                self.halves[c], self.age[c], entries[c] = (vocab[a], vocab[b]), n, raw(a + b)
        self.automaton = ahocorasick.Automaton()
        for i, text in entries.items():
            self.automaton.add_word(text.decode("latin-1"), (i, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of both tokens ends with these two tokens.

        Undo the merges of both sides from the youngest back; at each moment the tokens that touch
        across the border must not have a merge that would have come before the next one undone.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, bound, ok = left, right, 1 << 60, True
        while True:
            merge = self.joined.get((a, b))
            if merge is not None and merge < bound:
                ok = False
                break
            # undo the younger of the two; on the left a merge of equal age comes first (left to right)
            if self.age[a] > self.age[b]:
                bound, a = self.age[a], self.halves[a][1]
            elif self.age[b] >= 0:
                bound, b = self.age[b] + 1, self.halves[b][0]
            else:
                break
        if len(self.pairs) >= 4 * MEMO:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace").decode("latin-1")
        last: list[int] = [0] * (len(data) + 1)
        size: list[int] = [0] * (len(data) + 1)
        for end, (token, length) in self.automaton.iter(data):
            end += 1
            if size[end]:
                continue  # the last token of this prefix is unique and known
            start = end - length
            if start == 0 or (size[start] and self.fits(last[start], token)):
                last[end], size[end] = token, length
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_into(self, text: str, out: array) -> None:
        memo = self.memo
        for w in self.pieces(text):
            ids = memo.get(w)
            if ids is None:
                ids = self.piece(w)
                if len(w) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = ids
            out.extend(ids)

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()


def vocabulary(path: str) -> ByteBpe:
    """The vocabulary at path, made once per Python process."""
    if path not in _MADE:
        _MADE[path] = ByteBpe(path)
    return _MADE[path]


def _run(path: str, count: bool, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in (part for whole in batches for part in chunks(whole, keys, 10_000)):
            flat, ends = array("i"), array("i", [0])
            for t in b.column(keys).to_pylist():
                if t:
                    bpe.encode_into(t, flat)
                ends.append(len(flat))
            offsets = pa.array(ends, pa.int32())
            if count:
                import numpy as np

                made = pa.array(np.diff(np.frombuffer(ends, dtype=np.int32)).astype("int64"))
                name = "n_tokens"
            else:
                made = pa.ListArray.from_arrays(offsets, pa.array(np_ints(flat), pa.int32()))
                name = "ids"
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], made], names=[*b.schema.names[:keys], name])

    return run


def np_ints(flat: array):
    import numpy as np

    return np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32)


def _apply(df: DataFrame, text: str, keys: list[str], path: str | None, count: bool) -> DataFrame:
    ship(df.sparkSession)
    narrow = spread(df.select(*[F.col(k) for k in keys], F.col(text).alias("_text")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    out = "n_tokens bigint" if count else "ids array<int>"
    return narrow.mapInArrow(_run(path or default_path(), count, len(keys)), f"{kept}, {out}")


def encode(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Columns keys and ids: the token ids of each text, without special tokens.

    A null and an empty text both give an empty list; every input row gives one row, repeated rows
    included; strings that name special tokens are ordinary text. Other columns are dropped, so
    clashing names can't occur. No shuffle (but see spread).
    """
    return _apply(df, text, list(keys), path, False)


def token_counts(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Columns keys and n_tokens: the number of ids that encode gives; 0 for null and empty texts."""
    return _apply(df, text, list(keys), path, True)
