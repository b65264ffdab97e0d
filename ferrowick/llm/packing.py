"""Vector bin packing of token sequences for instruction data.

Examples meet three limits at once: tokens, segments and loss-bearing tokens of a sequence (the ids of
a prompt, or of a text's first line, bear none). A bin
is filled by the dot-product rule: of the waiting pieces that fit, take the one whose size
vector has the largest dot product with the bin's remaining capacity vector (both as shares of
the limits). When none fits whole, a piece is cut to fill the bin exactly and its rest waits on.

Every partition packs its own rows in one pass over a bounded pool, so nothing is shuffled and
no task holds more than a few thousand pieces. A bin that cannot be filled to the limit is cut
at a power of two, and a partition's last ids go out in sequences of powers of two, so no
sequence needs padding unless a single id breaks a limit.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import worker_cache

MAX_TOKENS, MAX_SEGMENTS, POOL = 4096, 12, 128
MAX_LOSS = 3840  # loss-bearing tokens of a sequence in the registered query and the pipeline
_ODD = re.compile("[^0-9A-Za-zÀ-ÖØ-öø-ÿ \\n][.,]")  # a stop or comma that may be inside a run of signs


class _Places(dict):
    """Words to their places in the cache; a new word gets the next place and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.waiting.append(word)
        return at


class WordTokenizer:
    """Ids of whole texts by a lower-casing, space-dropping word BPE file, through a bounded word cache.

    Spaces and line feeds always end a word of this tokenizer, and so does the step from a letter
    or digit to a stop or comma; ids of a text are the ids of its pieces between these, joined.
    Each distinct piece is encoded once while it is cached: plain lower-case Latin words by the
    bare model, all else by the whole tokenizer. Names of special tokens in a text are plain text, as
    the tokenizers' description has it (encode_special_tokens), or with ``special`` these tokens; a text that holds one is then encoded whole.
    """

    def __init__(self, path: str, most: int = 800_000, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.full.encode_special_tokens = not special
        names = [x["content"] for x in spec.get("added_tokens", ()) if special]
        self.named = re.compile("|".join(map(re.escape, names)), re.I) if names else None
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.bare.encode_special_tokens = True
        self.most = most
        self._clear()

    @classmethod
    def of(cls, path: str, special: bool = False) -> WordTokenizer:
        return worker_cache(f"tokenizer {path} {special}", lambda: cls(path, special=special))

    def _clear(self) -> None:
        self.words = _Places()
        self.flat, self.off, self.len = array("I", [0]), array("q"), array("q")

    def _learn(self, words: list[str]) -> None:
        plain = [w.isalpha() and w.islower() and (w.isascii() or max(w) <= "ÿ") for w in words]
        bare, full = (iter(tok.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if p == kind], add_special_tokens=False)) for tok, kind in ((self.bare, True), (self.full, False)))
        ids = [next(bare if p else full).ids for p in plain]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.off.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).tobytes())
        self.len.frombytes(sizes.tobytes())
        self.flat.extend(chain.from_iterable(ids))

    @staticmethod
    def _pieces(text: str) -> list[str]:
        text = text.replace("\n", " ")
        if text.isascii() or max(text) <= "ÿ":
            text = text.lower()
            if not _ODD.search(text):
                text = text.replace(".", " .").replace(",", " ,")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.most:
            self._clear()
        # a word with a special token's name may have spaces on either side of it: the whole text is one piece
        split = [[t] if self.named and self.named.search(t) else self._pieces(t) for t in texts]
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.words.waiting:
            self._learn(self.words.waiting)
            self.words.waiting = []
        flat, off, size = (np.frombuffer(x, d) for x, d in ((self.flat, np.uint32), (self.off, np.int64), (self.len, np.int64)))
        n = size[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(off[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.cumsum([len(w) for w in split])[:-1]
        return np.split(ids, ends[cut - 1]) if len(split) > 1 else [ids]


class Packer:
    """Fills bins from a pool; ``put`` and ``close`` give finished sequences as lists of pieces
    (item, start, length), item an index into whatever the caller keeps."""

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, pool: int = POOL):
        if max_tokens < 1 or max_segments < 1 or (max_loss is not None and max_loss < 1):
            raise ValueError("limits must be positive")
        self.limit = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss], np.float64)
        self.pool = pool
        self.items: list[tuple[int, int, int, int]] = []  # item, next start, end, first loss-bearing position

    def _size(self, start: int, end: int, loss_from: int) -> tuple[int, int, int]:
        return end - start, 1, max(0, end - max(start, loss_from))

    def put(self, item: int, length: int, loss_from: int = 0) -> Iterator[list[tuple[int, int, int]]]:
        start, most = 0, int(min(self.limit[0], self.limit[2]))
        while start < length:  # a piece fits an empty sequence
            self.items.append((item, start, min(start + most, length), loss_from))
            start += most
            while len(self.items) >= self.pool:
                yield from self._bin(last=False)

    def close(self) -> Iterator[list[tuple[int, int, int]]]:
        while self.items:
            yield from self._bin(last=True)

    def _bin(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        sizes = np.array([self._size(*x[1:]) for x in self.items], np.float64)
        open_, room, bin_ = np.ones(len(sizes), bool), self.limit.copy(), []
        shares = sizes / self.limit
        while True:
            fits = open_ & (sizes <= room).all(1)
            if not fits.any():
                break
            score = np.where(fits, shares @ (room / self.limit), -1.0)
            k = int(score.argmax())
            item, start, end, loss_from = self.items[k]
            bin_.append((item, start, end - start, loss_from))
            open_[k] = False
            room -= sizes[k]
        rest = [x for x, o in zip(self.items, open_, strict=True) if o]
        if rest and room[0] > 0 and room[1] > 0:
            left = sizes[open_]
            part = np.minimum(left[:, 0], np.minimum(room[0], left[:, 0] - left[:, 2] + room[2]))  # what the room takes of each
            i = int(part.argmax())
            if n := int(part[i]):
                item, start, end, loss_from = rest[i]
                bin_.append((item, start, n, loss_from))
                if start + n < end:
                    rest[i] = (item, start + n, end, loss_from)
                else:
                    del rest[i]
        total = sum(x[2] for x in bin_)
        if not total:
            raise AssertionError("a waiting piece fits no empty bin")
        goal = total if total == self.limit[0] else 1 << (total.bit_length() - 1)
        kept, made = [], 0
        for item, start, n, loss_from in bin_:
            take = min(n, goal - made)
            if take:
                kept.append((item, start, take))
            if take < n:
                rest.append((item, start + take, start + n, loss_from))
            made += take
        self.items = rest
        yield kept


OUT = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("segment", "int"), ("loss_tokens", "long"), ("sequence_tokens", "long"), ("sequence_segments", "long"), ("sequence_loss", "long")]


def first_line(text: str) -> tuple[str, str]:
    """A text's first line and the rest; a text of a single line has no first line but only the rest."""
    head, _, rest = text.partition("\n")
    return (head, rest) if rest else ("", text)


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", prompt: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = 2, with_ids: bool = True, head_is_prompt: bool = False, special: bool = False) -> DataFrame:
    """Packs all rows into sequences: one row per piece with key, start (ids of its row before
    it), length, ids_crc32, doc_tokens, sequence_id, offset in the sequence (gapless from 0),
    segment (its number there), loss_tokens, the sums of its sequence over the three limits
    (sequence_tokens, sequence_segments, sequence_loss) and, if ``with_ids``, ids.

    A row's ids are the ids of ``prompt`` (a column whose ids bear no loss; none if not named),
    then of ``text``, then ``end_id``. With ``head_is_prompt`` the ids of the first line of a text of
    several lines bear no loss either. At most ``max_tokens`` ids, ``max_segments`` pieces and
    ``max_loss`` loss-bearing ids stand in a sequence. With ``special`` the names
    of the tokenizer's special tokens in a text are these tokens, else plain text. Null texts count as empty, so every row has at least one
    id. Repeated rows and keys are packed each on their own, null keys pass through, other
    columns are ignored and an empty table gives no rows. Sequence ids are the partition's
    number times 2**32 plus a count, so a repeated task makes the same rows again.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} {t}" for c, t in OUT) + (", ids array<int>" if with_ids else "")
    cols = [F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), (F.col(prompt).cast("string") if prompt else F.lit(None).cast("string")).alias("_prompt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = WordTokenizer.of(tokenizer_path, special), Packer(max_tokens, max_segments, max_loss)
        base, made, n = TaskContext.get().partitionId() << 32, 0, 0
        docs: dict[int, list] = {}  # item -> [key as a one-row array, ids, loss_from, ids not yet out]
        key_type, rows = None, []

        def out(seqs: Iterator[list[tuple[int, int, int]]]) -> None:
            nonlocal made
            for seq in seqs:
                at, total = 0, sum(x[2] for x in seq)
                loss = [max(0, start + length - max(start, docs[item][2])) for item, start, length in seq]
                for s, (item, start, length) in enumerate(seq):
                    d = docs[item]
                    ids = d[1][start : start + length]
                    rows.append((d[0], start, length, zlib.crc32(np.ascontiguousarray(ids, "<u4").data), len(d[1]), base + made, at, s, loss[s], total, len(seq), sum(loss), ids))
                    at += length
                    d[3] -= length
                    if not d[3]:
                        del docs[item]
                made += 1

        def flush() -> pa.RecordBatch:
            keys, *cols = zip(*rows, strict=True)
            arrays = [pa.array(keys, key_type), *(pa.array(c, pa.int32() if name == "segment" else pa.int64()) for c, (name, _) in zip(cols, OUT, strict=False))]
            if with_ids:
                ends = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(x) for x in cols[-1]], out=ends[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[-1]).astype(np.int32))))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [key, *(c for c, _ in OUT), *(["ids"] if with_ids else [])])

        for b in batches:
            key_type = b.schema.field(0).type
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                prompts = [t or "" for t in part.column(2).to_pylist()]
                heads = tok.encode(prompts) if any(prompts) else None
                if head_is_prompt:
                    lines = [first_line(t) for t in texts]
                    firsts, ids = tok.encode([a for a, _ in lines]), tok.encode([b for _, b in lines])
                else:
                    firsts, ids = None, tok.encode(texts)
                for i, k in enumerate(part.column(0).to_pylist()):
                    head = [x[i] for x in (heads, firsts) if x]
                    free = sum(map(len, head))
                    whole = np.concatenate([*head, ids[i], np.array([end_id], np.uint32)])
                    docs[n] = [k, whole, free, len(whole)]
                    out(packer.put(n, len(whole), free))
                    n += 1
                if len(rows) >= 2000:
                    yield flush()
        out(packer.close())
        if rows:
            yield flush()

    return df.select(*cols).mapInArrow(run, schema)
