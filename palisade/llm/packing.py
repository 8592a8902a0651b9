"""Vector bin packing of tokenised documents into training sequences.

A sequence has limits on tokens, on segments and on loss-bearing tokens at once. It is
filled piece by piece with the example whose demands have the largest dot product with
what the sequence has left, both as shares of the limits; of equal ones the one that came
first. When no whole example fits, the best one is cut, so sequences end up full. The first
part of a document stands for its prompt, which bears no loss: column `loss_from`, or the
`PROMPT`-th part of its tokens. Where segments or loss run out before the tokens do, the
sequence keeps a power of two of its tokens, which needs no padding, and gives the others
back, unless fewer than `SLACK` of its places would be padding. What is left at the end of
a partition goes to sequences of power-of-two length.

Every partition packs its own rows in one pass and holds one batch of them, so there is
no shuffle; a sequence's id is the partition's number and a counter, the same again when
a lost task reruns. Null or empty texts are documents of one token, the end id. Repeated
rows are packed each. Extra columns are ignored. An empty table gives no sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from palisade.llm import wordhash as wh
from palisade.llm.common import read, small_batches

LENGTH, SEGMENTS, LOSS, PROMPT, SLACK, END = 4096, 16, 3840, 8, 1 / 64, 2
MEMO = 600_000
SCAN = 1 << 22
#: Letters of ASCII and Latin-1, in UTF-8, or marks: no apostrophe, which begins contractions, and no <, which begins special tokens.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:;=-@\[-`{-~]+")
_KIND = np.array([1 if chr(i).isalpha() else 2 if PLAIN.fullmatch(bytes([i])) else 0 for i in range(128)] + [0] * 128, np.uint8)
_SECOND = np.array([PLAIN.fullmatch(bytes([0xC3, i])) is not None for i in range(256)])


def _units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bytes with plain words (letters, then marks or none) in lower case; starts and ends of words, plain ones cut before
    their marks; and each text's first of these, one more at the end."""
    starts, ends, first = wh.bounds(raw, offsets)
    kind = _KIND[raw]
    pair = np.flatnonzero((raw[:-1] == 0xC3) & _SECOND[raw[1:]])
    kind[pair] = kind[pair + 1] = 1
    again = np.zeros(len(raw), bool)  # letters behind a mark
    again[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
    again[starts] = False
    odd, marks = np.zeros((2, len(raw) + 1), np.int32)
    np.cumsum((kind == 0) | again, out=odd[1:])
    np.cumsum(kind == 2, out=marks[1:])
    plain = (kind[starts] == 1) & (odd[ends] == odd[starts])
    own = np.where(plain, marks[ends] - marks[starts], 0)
    within = np.zeros(len(raw) + 1, np.int8)
    within[starts[plain]] += 1
    within[ends[plain]] -= 1
    within = np.cumsum(within[:-1], dtype=np.int8) == 1
    upper = (raw >= 65) & (raw <= 90)
    upper[pair + 1] = raw[pair + 1] <= 0x9E
    low = raw + np.uint8(32) * (upper & within)
    at = np.arange(len(starts) + 1)
    at[1:] += np.cumsum(own > 0)
    begin, stop = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    begin[at[:-1]], stop[at[:-1]] = starts, ends - own
    cut = own > 0
    begin[at[:-1][cut] + 1], stop[at[:-1][cut] + 1] = (ends - own)[cut], ends[cut]
    return low, begin, stop, at[first]


class WordTokens:
    """Ids of whole texts from a memo of blank-separated words: this tokenizer drops white space, so words don't interact.

    Words are looked up once for a stretch of texts, and their ids are put together as arrays. Words of letters, with marks behind
    them or not, are the ids of the letters, which this tokenizer lower-cases, and of the marks; new ones are encoded thousands at
    a time as one text, where each ends with the one token of it that ends a word. Other words are encoded one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(True)
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array | list[str | None], end: int) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        for _, _, raw, offsets in wh.chunks(column, SCAN):
            if len(self.new) > MEMO:
                self.new, self.old = {}, self.new
            low, starts, ends, first = _units(raw, offsets)
            coded = wh.coded(low, starts, ends)
            data, at = wh.texts(coded.dictionary)
            data, at = data.tobytes(), at.tolist()
            found = [*self._ids([data[a:b] for a, b in zip(at, at[1:])]), array("I", [end]).tobytes()]
            pool, sizes = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64) // 4
            words = np.insert(coded.indices.to_numpy(), first[1:], len(found) - 1)
            n = sizes[words]
            stops = np.cumsum(n)
            ids = pool[np.repeat((np.cumsum(sizes) - sizes)[words] - (stops - n), n) + np.arange(stops[-1])].tobytes()
            cuts = (4 * stops[first[1:] + np.arange(len(offsets) - 1)]).tolist()
            out += [ids[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, words))
        unknown = [w for w, x in zip(words, found) if x is None]
        if not unknown:
            return found
        if self.old:
            self.new.update((w, self.old[w]) for w in unknown if w in self.old)
            unknown = [w for w in unknown if w not in self.new]
        parts = list(filter(PLAIN.fullmatch, unknown))
        for at in range(0, len(parts), 4096):
            part = parts[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                stops, ids = (4 * stops).tolist(), ids.tobytes()
                self.new.update((p, ids[a:b]) for p, a, b in zip(part, [0, *stops], stops))
        todo = [w for w in unknown if w not in self.new]
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            several = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.new.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, several))
        return [self.new[w] if x is None else x for w, x in zip(words, found)]


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker."""
    return WordTokens(path)


class Packer:
    """Open examples of one partition; `fill` closes one sequence."""

    def __init__(self, length: int, segments: int, loss: int, first_id: int):
        self.caps = np.array([length, segments, loss], float)
        self.next = first_id
        self.items: list[list] = []  # (key, ids), tokens, start, first loss-bearing position

    def add(self, key: object, ids: bytes, from_: int) -> None:
        self.items.append([(key, ids), len(ids) // 4, 0, from_])

    def total(self) -> int:
        return sum(i[1] - i[2] for i in self.items)

    def pack(self, rest: bool) -> Iterator[tuple]:
        """Pieces of full sequences; with `rest` of all that is left."""
        total = self.total()
        while total and (rest or total >= self.caps[0]):
            goal = int(min(self.caps[0], 1 << (total.bit_length() - 1)))
            for piece in self.fill(goal):
                total -= piece[2]
                yield piece

    def fill(self, goal: int) -> list[tuple]:
        left = self.caps.copy()
        left[0] = goal
        size, start, from_ = np.array([i[1:] for i in self.items], float).reshape(-1, 3).T
        sizes, free = size - start, np.maximum(from_ - start, 0.0)  # free: tokens without loss, at the front
        taken: list[list[int]] = []  # item, tokens
        while left[0] > 0 and left[1] > 0:
            room = np.minimum(np.minimum(sizes, left[0]), free + left[2])
            loss = np.maximum(sizes - free, 0.0)
            score = left[0] / self.caps[0] * sizes / self.caps[0] + left[2] / self.caps[2] * loss / self.caps[2] + left[1] / self.caps[1] ** 2
            whole = (room > 0) & (room == sizes)
            pick = int(np.argmax(np.where(whole if whole.any() else room > 0, score, -1.0)))
            n = int(room[pick])
            if n <= 0:
                break
            taken.append([pick, n])
            bearing = max(0.0, n - free[pick])
            sizes[pick] -= n
            free[pick] = max(0.0, free[pick] - n)
            left -= [n, 1, bearing]
        used = sum(n for _, n in taken)
        if not used:
            raise ValueError("the limits leave no room for a single token")
        if used < self.caps[0] * (1 - SLACK):
            extra = used - (1 << used.bit_length() - 1)
            while extra:
                back = min(extra, taken[-1][1])
                taken[-1][1] -= back
                extra -= back
                if not taken[-1][1]:
                    taken.pop()
        out, used = [], 0
        for pick, n in taken:
            (key, ids), size, start, _ = item = self.items[pick]
            out.append((key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), size, self.next, used))
            item[2] = start + n
            used += n
        self.items = [i for i in self.items if i[1] > i[2]]
        self.next += 1
        return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LOSS, prompt: int = PROMPT, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An integer column `loss_from` in `docs`, if any, says at which token the loss-bearing
    part of a document starts; without it a `prompt`-th of its tokens come before.
    """
    has_loss = "loss_from" in docs.columns
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        packer = Packer(length, segments, loss, TaskContext.get().partitionId() << 40)
        kind = None

        def out(rest: bool) -> Iterator[pa.RecordBatch]:
            rows = list(packer.pack(rest))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            kind = batch.column(0).type
            ids = tokens.encode(batch.column(1), end)
            from_ = batch.column(2).to_pylist() if has_loss else [len(i) // 4 // prompt for i in ids]
            for k, i, f in zip(batch.column(0).to_pylist(), ids, from_):
                packer.add(k, i, f or 0)
            yield from out(False)
        if kind is not None:
            yield from out(True)

    small_batches(docs.sparkSession, 500)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "text", *["loss_from"] * has_loss]
    return docs.select(*cols).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
