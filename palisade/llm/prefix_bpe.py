"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that its encoding ends with: a
token that is a suffix of the prefix and stays apart from the last token of what is left.
An automaton with suffix links over the vocabulary lists the tokens that end at each
position; `Vocabulary.apart` tells whether two neighbours would have merged. Following
the stored tokens back from the end gives the ids that merging by rank gives.

Pieces are a run of blanks with the run of other characters behind it: no pre-token
reaches from other characters into blanks, so each piece is encoded for itself, once.
Null texts are encoded as empty ones: no ids. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import read, small_batches

#: The pre-token pattern of this kind of vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_ODD_BLANKS = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
MEMO = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.merged, self.parts = {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merged[ids[left], ids[right]] = rank
            self.parts[ids[left + right]] = (rank, ids[left], ids[right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._mark = os.path.commonprefix(list(self.special))  # cheaper to look for than the tokens, if they share it
        self._pretoken = regex.compile(PRETOKEN)
        self.suffixes = ahocorasick.Automaton()
        for t, i in ids.items():
            word = bytes(letters[c] for c in t)
            self.suffixes.add_word(word.decode("latin-1"), (i, len(word)))
        self.suffixes.make_automaton()
        self._apart: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge while `token` is put together, each with the rank that ends its time."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, *pair = self.parts[token]
            token = pair[side]

    def apart(self, left: int, right: int) -> bool:
        """No merge across the border comes before what either side does there; of equal pairs the leftmost goes first."""
        known = self._apart.get((left, right))
        if known is None:
            known = True
            for x, x_until in self._edge(left, 1):
                for y, y_until in self._edge(right, 0):
                    rank = self.merged.get((x, y))
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
            if len(self._apart) > 4 * MEMO:
                self._apart.clear()
            self._apart[left, right] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        last: list[int] = [-1] * (len(word) + 1)
        size = [0] * (len(word) + 1)
        done = [False] * (len(word) + 1)
        for end, (token, n) in self.suffixes.iter(word.decode("latin-1")):
            to, at = end + 1, end + 1 - n
            if not done[to] and (at == 0 or done[at] and self.apart(last[at], token)):
                last[to], size[to], done[to] = token, n, True
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_piece(self, text: str) -> bytes:
        return array("I", [i for word in self._pretoken.findall(text) for i in self.encode_word(word.encode())]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        out, at = [], 0
        for m in self._special.finditer(text) if self._special and self._mark in text else ():
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        if _ODD_BLANKS.search(text):
            return self.encode_piece(text)
        return b"".join(map(self.memo.__getitem__, _PIECE.findall(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


class _Memo(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = self.vocabulary.encode_piece(piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also `ids` and `decoded` themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = [v.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [v.decode(i) for i in ids]
            cols = [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols += [pa.array([memoryview(i).cast("I").tolist() for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
