"""Exact Jaccard self-join of word n-gram sets through a token-group matrix.

Equal sets are one class and are compared once. The sets' tokens (64-bit hashes of n words) get one
global order, rare tokens first; two sets of similarity t share a token among the first
n - ceil(t n) + 1 of each. Rareness is counted exactly over all classes, for the tokens in a
fixed share of the hash space, and kept in tables that grow with the number of repeated tokens; what
the tables do not know counts as frequent, so they only decide the order, never the result.

* Tokens of few sets (at most FEW) have short lists; the sets of a list are compared directly.
* Sets whose prefix reaches frequent tokens are partitioned into groups: by their rarest
  frequent token, then by size band, then into blocks of bounded volume. The token-group matrix
  says which groups hold which parts of a set: tokens are dealt over more parts than two similar sets
  have differing tokens, so such sets have all tokens of some part in common. The groups that hold a
  part are a list; texts that share a passage only make long lists, so a list's groups are not paired
  but come together with their sets' parities, bits that each token flips one of, and a pair
  is made where these allow a link. Of a pair the sets' sketches, a bit
  for each hash value of a token, are compared next. If they allow a link, each set's overlap with
  the union of the other group's tokens bounds its overlap with any member. Only sets that pass
  are opened, and they are compared block by block as 0/1 matrices. A group of copies that holds
  a third of all rows becomes many blocks of one size, and each block pair returns a spanning
  forest of its links, never all pairs.

Links join classes to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import worker_cache
from .common import Workspace, components, free_name

WORDS, PERCENT = 4, 85
FEW = 8
REGION = 0.35  # share of the hash space in which rareness is counted
COUNTED = 24  # low bits of a token that counting leaves out
BITS, LEVELS = (20, 29), (20, 25)  # least and greatest binary logarithm of the cells of the two tables
CELL = 4096  # bytes of a table that one task packs
DEALS = 32  # ways to deal a set's tokens over parts that are tried
VOLUME = 150_000  # tokens of a block
PARITY = 4096  # bytes of parities that a group brings along; groups with more are paired with all of their lists
COMPARED = 1 << 19  # 64-bit words of parities that are compared at once
_MASK48 = np.uint64((1 << 48) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """Words to their hashes, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Texts to sorted distinct 64-bit shingles; word hashes are cached, bounded."""

    def __init__(self, words: int = WORDS, most: int = 400_000):
        self.n, self.most = words, most
        self.seen = _Hashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.seen) > self.most:
            self.seen = _Hashes()
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: only A-Z, only ASCII space
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(sizes)
        h = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
        over = self._runs(h, self.n)  # of all texts at once; runs that cross from one to the next are not looked at
        out = []
        for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            if n < self.n:
                out.append(self._runs(h[end - n : end], n))
                continue
            s = np.sort(over[end - n : end - self.n + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        return out

    @staticmethod
    def _runs(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k words, k included."""
        if not k or len(h) < k:
            return np.zeros(0, np.uint64)
        s = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
        return _mix(s)


def need(n: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of a set of n tokens with a similar one."""
    return -(-n * percent // 100)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_digest(s.tobytes())
    return tuple(np.frombuffer(d, np.int64).tolist())


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))


def set_table(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n, f1, f2, region): set size, fingerprint, and, for the first such set of a task, its
    tokens in the counted region (upper 40 bits, so that few of a large corpus are the same)."""
    kind = dict(docs.dtypes)[key]
    top = np.uint64(int(REGION * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = worker_cache(f"shingles {words}", lambda: Shingler(words)), set()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingler.sets(part.column(1).to_pylist())
                prints = [_fingerprint(s) for s in sets]
                region = []
                for s, f in zip(sets, prints, strict=True):
                    new = len(s) > 0 and f not in seen
                    seen.add(f)
                    region.append((s[: np.searchsorted(s, top)] >> np.uint64(COUNTED)).view(np.int64) if new else None)
                cols = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f[i] for f in prints], pa.int64()) for i in (0, 1)), pa.array(region, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["_key", "n", "f1", "f2", "region"])

    return _keys(docs, key, text).mapInArrow(run, f"_key {kind}, n long, f1 long, f2 long, region array<long>")


def _log_cells(least: int, bounds: tuple[int, int]) -> int:
    return min(max(max(least - 1, 0).bit_length(), bounds[0]), bounds[1])


def _packed(cells: DataFrame, size: int, bits: bool) -> np.ndarray:
    """A table of ``size`` bytes from rows (cell, level): the greatest level of each byte, or a bit for each cell."""
    span = CELL * 8 if bits else CELL

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(span, np.uint8)
        np.maximum.at(out, pdf["at"].to_numpy(), pdf["level"].to_numpy().astype(np.uint8))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [(np.packbits(out) if bits else out).tobytes()]})

    table = np.zeros(size, np.uint8)
    rows = cells.select((F.col("cell") / span).cast("int").alias("part"), (F.col("cell") % span).cast("int").alias("at"), "level")
    # one job, not one a partition; at most size / CELL rows of CELL bytes
    for r in rows.groupBy("part").applyInPandas(pack, "part int, data binary").collect():
        table[r["part"] * CELL : (r["part"] + 1) * CELL] = np.frombuffer(r["data"], np.uint8)
    return table


class Levels:
    """What is known of the tokens in the counted region: a bit per cell where a token of two or more classes falls, and
    a byte per cell with the greatest level of the frequent ones. Levels are 0 for tokens of one class, 1 for up to
    FEW classes, then one more for each doubling."""

    def __init__(self, bits: np.ndarray, levels: np.ndarray):
        self.bits, self.levels = bits, levels

    def of(self, t: np.ndarray) -> np.ndarray:
        at = t & np.uint64(len(self.bits) * 8 - 1)
        seen = (self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1)
        level = self.levels[(t >> np.uint64(7)) & np.uint64(len(self.levels) - 1)]
        return np.where(seen == 1, np.maximum(level, 1), 0).astype(np.uint8)


def level_table(ws: Workspace, sets: DataFrame) -> Levels:
    """The tables of ``Levels``, with four cells for each repeated token and sixteen for each frequent one, within BITS and LEVELS."""
    one = sets.where("region is not null").groupBy("f1", "f2").agg(F.first("region").alias("region"))
    counts = one.select(F.explode("region").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    level = F.least(F.when(F.col("c") <= FEW, 1).otherwise(F.ceil(F.log2(F.col("c") / FEW)) + 1), F.lit(30)).cast("int")
    counts = ws.save(counts.select("t", level.alias("level")), "counts")
    repeated, frequent = counts.agg(F.count("*"), F.count(F.when(F.col("level") > 1, 1))).first()
    nb, nl = _log_cells(4 * repeated, BITS), _log_cells(16 * frequent, LEVELS)
    cell = lambda t, n: t.bitwiseAND((1 << n) - 1)
    bits = _packed(counts.select(cell(F.col("t"), nb).alias("cell"), F.lit(1).alias("level")), 1 << nb - 3, True)
    levels = _packed(counts.where("level > 1").select(cell(F.shiftright("t", 7), nl).alias("cell"), "level"), 1 << nl, False)
    ws.drop("counts")
    return Levels(bits, levels)


def sketch(s: np.ndarray) -> bytes:
    """A bit for each hash value of a token, for twice as many values as there are tokens, rounded up to a power of two and whole bytes."""
    bits = np.zeros(max(8, 1 << (2 * len(s) - 1).bit_length()), np.uint8)
    bits[(s >> np.uint64(16)) & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits).tobytes()


def may_link(one: list[bytes], n1: np.ndarray, two: list[bytes], n2: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches of sets of sizes n1 and n2 allow a link of each with each: a bit that only one set has stands for a token that only it has."""
    width = min(map(len, chain(one, two)))

    def folded(all_bits: list[bytes]) -> np.ndarray:
        rows = [np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0) for b in all_bits]
        return np.unpackbits(np.array(rows), axis=1).astype(np.float32)

    x, y = folded(one), folded(two)
    both = x @ y.T
    most = np.minimum(n1[:, None] - x.sum(1)[:, None] + both, n2[None, :] - y.sum(1)[None, :] + both)
    return (100 + percent) * most >= percent * (n1[:, None] + n2[None, :])


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of tokens has a hash value, for each of as many values as there are tokens, rounded up to a power of two and 64."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    at = (s >> np.uint64(16)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def alike(sizes: list[np.ndarray], parities: list[list[bytes] | None], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of groups that some of their sets' parities allow to be linked, by parts; a group without parities goes with all others.

    Each token that only one of two sets has changes one bit at most, so the sets have no fewer such tokens than differing bits.
    """
    known = np.array([p is not None for p in parities], bool)
    for i in np.flatnonzero(~known):
        j = np.flatnonzero(known | (np.arange(len(known)) > i))
        if len(j):
            yield np.minimum(i, j), np.maximum(i, j)
    if known.sum() < 2:
        return
    mine = [k for k in np.flatnonzero(known) for _ in parities[k]]
    owner, n = np.array(mine), np.concatenate([sizes[k] for k in np.flatnonzero(known)])
    data = [b for p in parities if p is not None for b in p]
    width = min(map(len, data))
    words = np.array([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0) for b in data])
    step = max(1, COMPARED // words.size)
    for s in range(0, len(words), step):
        differ = np.bitwise_count(words[s : s + step, None] ^ words[None, s:]).sum(2, dtype=np.int64)
        differ = np.maximum(differ, np.abs(n[s : s + step, None] - n[None, s:]))
        x, y = np.nonzero((100 + percent) * differ <= (100 - percent) * (n[s : s + step, None] + n[None, s:]))
        x, y = owner[x + s], owner[y + s]  # in the groups' order
        if (ok := x < y).any():
            yield tuple(np.unique(np.stack([x[ok], y[ok]]), axis=1))


def prefix_table(docs: DataFrame, key: str, text: str, words: int, percent: int, levels: Levels) -> DataFrame:
    """One row per class that may have a partner: (f1, n, light, heavy, bits, toks). light: prefix tokens of
    2 to FEW classes; heavy: the first prefix token that is frequent or not counted, if any; bits:
    the set's sketch; toks: the whole set, six bytes a token."""
    cast = docs.sparkSession.sparkContext.broadcast(levels)
    top = np.uint64(int(REGION * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, levels = worker_cache(f"shingles {words}", lambda: Shingler(words)), set(), cast.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = []
                for s in shingler.sets(b.column(1).slice(at, 512).to_pylist()):
                    n = len(s)
                    if not n or (f := _fingerprint(s)) in seen:
                        continue
                    seen.add(f)
                    known = int(np.searchsorted(s, top))
                    short = s >> np.uint64(COUNTED)
                    level = np.full(n, 31, np.uint8)
                    level[:known] = levels.of(short[:known])
                    first = np.argsort(level, kind="stable")[: n - need(n, percent) + 1]  # by level, then hash
                    lv = level[first]
                    light, heavy = first[lv == 1], first[lv > 1]
                    if len(light) or len(heavy):
                        toks = np.ascontiguousarray(s & _MASK48).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                        rows.append((f[0], f[1], n, short[light].view(np.int64), int(short[heavy[0]]) if len(heavy) else None, sketch(s & _MASK48), toks))
                if rows:
                    c = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(c, types, strict=True)], ["f1", "f2", "n", "light", "heavy", "bits", "toks"])

    rows = _keys(docs, key, text).mapInArrow(run, "f1 long, f2 long, n long, light array<long>, heavy long, bits binary, toks binary")
    return rows.groupBy("f1", "f2").agg(*[F.first(c).alias(c) for c in ("n", "light", "heavy", "bits", "toks")]).drop("f2")


def _tokens(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def light_links(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): similar classes that share a token of at most FEW classes."""
    lists = sets.select(F.explode("light").alias("t"), F.struct("f1", "n").alias("s")).groupBy("t").agg(F.sort_array(F.collect_list("s")).alias("l"))
    lists = lists.where(F.size("l") > 1).select("l").distinct()  # of at most FEW sets; copies give the same list for many tokens
    each = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.greatest(F.size("l") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists.select(F.explode(each).alias("p")).where(f"100 * least(p.x.n, p.y.n) >= {percent} * greatest(p.x.n, p.y.n)")
    pairs = ws.save(pairs.select(F.col("p.x.f1").alias("a"), F.col("p.y.f1").alias("b")).distinct(), "pairs")
    t = sets.select("f1", "n", "bits")
    drawn = pairs.join(t.toDF("a", "na", "x"), "a").join(t.toDF("b", "nb", "y"), "b").select("a", "b", "na", "x", "nb", "y")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = zip(*[b.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True)
            ok = [bool(may_link([x], np.array([n]), [y], np.array([m]), percent)[0, 0]) for n, x, m, y in cols]
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    pairs = ws.save(drawn.mapInArrow(allowed, "a long, b long"), "allowed")
    t = sets.select("f1", "toks")
    both = pairs.join(t.select(F.col("f1").alias("a"), F.col("toks").alias("ta")), "a").join(t.select(F.col("f1").alias("b"), F.col("toks").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = _tokens(x.as_py()), _tokens(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _forest(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Numbers of the links that make a spanning forest."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    keep = []
    for i, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            keep.append(i)
    return keep


def _overlaps(ta, oa, na, tb, ob, nb, common) -> np.ndarray:
    """Exact overlap counts of na x nb sets, from their (token, owner) lists, over the given tokens."""
    out = np.zeros((na, nb), np.float32)
    for s in range(0, len(common), 4096):
        part = common[s : s + 4096]
        x, y = np.zeros((na, len(part)), np.float32), np.zeros((nb, len(part)), np.float32)
        for m, t, o in ((x, ta, oa), (y, tb, ob)):
            i = np.searchsorted(part, t)
            hit = (i < len(part)) & (part[np.minimum(i, len(part) - 1)] == t)
            m[o[hit], i[hit]] = 1
        out += x @ y.T
    return out


def group_pair_links(one: tuple, two: tuple, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two groups (ids, sizes, tokens): bound each set against the other group's union, open what passes."""
    ids1, n1, t1 = one
    ids2, n2, t2 = two
    o1, o2 = np.repeat(np.arange(len(ids1)), n1), np.repeat(np.arange(len(ids2)), n2)
    u2, c2 = np.unique(t2, return_counts=True)
    common = u2[c2 > 1] if same else np.intersect1d(np.unique(t1), u2, assume_unique=True)

    def passing(t, o, n, least):
        bound = np.bincount(o[np.isin(t, common)], minlength=len(n))
        return bound >= np.maximum(need(n, percent), -(-(n + least) * percent // (100 + percent)))

    k1 = passing(t1, o1, n1, n2.min())
    k2 = k1 if same else passing(t2, o2, n2, n1.min())
    none = np.zeros(0, np.int64)
    if not k1.any() or not k2.any():
        return none, none
    m1, m2 = k1[o1], k2[o2]
    r1, r2 = np.cumsum(k1) - 1, np.cumsum(k2) - 1
    inter = _overlaps(t1[m1], r1[o1[m1]], int(k1.sum()), t2[m2], r2[o2[m2]], int(k2.sum()), common)
    union = n1[k1][:, None] + n2[k2][None, :] - inter
    x, y = np.nonzero(100 * inter >= percent * union)
    a, b = ids1[k1][x], ids2[k2][y]
    ok = a != b
    a, b = a[ok], b[ok]
    keep = _forest(a, b)
    return a[keep], b[keep]


@cache
def _parts(band: int, percent: int) -> tuple[int, int]:
    """Into how many parts the tokens of sets of this size band and the next are dealt, and how many of them similar sets have in common at least.

    Similar sets differ in at most the smaller one's size times (100 - percent) / percent tokens. There are about as
    many parts to spare as stay empty where the least sets are dealt by chance.
    """
    most = int(exp(log(100 / percent) * (1 + 1e-9) * (band + 1))) + 1  # no set of the band is larger
    differ, spare = (100 - percent) * most // percent, 1
    while (differ + spare) * exp(-most * percent / 100 / (differ + spare)) > spare - 0.5 and 2 * spare < differ:
        spare += 1
    return differ + spare, spare


def part_names(s: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Names of the set's parts. Two similar sets, of one band or of neighbouring ones, have a name in common.

    A set's parts for its own band and for the one below are named, as either may be the smaller set's. Empty
    parts tell nothing. Where more are empty than similar sets are sure to share, the tokens are dealt once more, another
    way: of two similar sets the first to have enough parts finds the other, which was dealt as often, among them.
    """
    out = []
    for b in (band, band - 1):
        if b < 0:
            continue
        parts, spare = _parts(b, percent)
        for deal in range(DEALS):
            salt = np.uint64((b * DEALS + deal + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = _mix(s + salt)
            part = h % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            out.append(_mix((np.add.reduceat(h[order], first) ^ salt) + part[first]))
            if parts - len(first) < spare:
                break
        else:
            out.append(np.array([b], np.uint64))  # all sets that no deal was good for share this name
    return np.concatenate(out).view(np.int64)


def heavy_links(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links, up to connection within a pair of groups, of classes that have a frequent prefix token."""
    h = sets.where("heavy is not null").select("f1", "n", "bits", "toks", F.col("heavy").alias("g"), F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9))).cast("int").alias("band"))  # sizes of similar sets are at most one band apart, rounding included
    h = ws.save(h, "heavy")
    volume = h.groupBy("g", "band").agg(F.ceil(F.sum("n") / VOLUME).alias("blocks"))
    h = h.join(volume, ["g", "band"]).withColumn("block", F.pmod(F.xxhash64("f1"), F.col("blocks")))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        sets = [_tokens(x) for x in pdf["toks"]]
        sig = np.unique(np.concatenate([part_names(x, int(first["band"]), percent) for x in sets]))
        odd = [parity(x) for x in sets]
        odd = odd if sum(map(len, odd)) <= PARITY else None
        name = xxhash.xxh64_intdigest(f"{first['g']} {first['band']} {first['block']}") >> 1
        return pd.DataFrame({"id": [name], "band": [first["band"]], "ids": [pdf["f1"].to_numpy(np.int64).tobytes()], "ns": [pdf["n"].to_numpy(np.int64).tobytes()], "bits": [list(pdf["bits"])], "odd": [odd], "toks": [b"".join(pdf["toks"])], "sig": [sig]})

    h = h.repartition("g", "band", "block")  # else the dealing by (g, band) that the join may leave would do, and a hot group be one task
    groups = ws.save(h.groupBy("g", "band", "block").applyInPandas(gather, "id long, band int, ids binary, ns binary, bits array<binary>, odd array<binary>, toks binary, sig array<long>"), "groups")
    matrix = groups.select("id", F.explode("sig").alias("part")).groupBy("part").agg(F.sort_array(F.collect_list("id")).alias("l"))
    lists = matrix.where(F.size("l") > 1).select("l").distinct()  # copies give the same list for many parts
    lists = lists.select(F.xxhash64("l").alias("k"), F.explode("l").alias("id"))  # lists of one hash are one longer list
    own = groups.select("id", F.when(F.col("odd").isNotNull(), F.col("ns")).alias("ns"), "odd")
    lists = ws.save(lists, "lists").join(own, "id").groupBy("k").agg(F.collect_list(F.struct("id", "ns", "odd")).alias("l"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                l = b.column(0)[k].as_py()
                ids = np.array([g["id"] for g in l], np.int64)
                for x, y in alike([np.frombuffer(g["ns"] or b"", np.int64) for g in l], [g["odd"] for g in l], percent):
                    x, y = ids[x], ids[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["id", "id2"])

    pairs = lists.select("l").mapInArrow(draw, "id long, id2 long").where("id < id2").distinct()
    drawn = groups.select("id", "ns", "bits")
    drawn = ws.save(pairs, "drawn").join(drawn, "id").join(drawn.toDF("id2", "ns2", "bits2"), "id2").select("id", "id2", "ns", "bits", "ns2", "bits2")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for i in range(b.num_rows):
                n1, one, n2, two = (b.column(k)[i].as_py() for k in (2, 3, 4, 5))
                ok.append(bool(may_link(one, np.frombuffer(n1, np.int64), two, np.frombuffer(n2, np.int64), percent).any()))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    pairs = ws.save(drawn.mapInArrow(allowed, "id long, id2 long"), "grouppairs")
    body = groups.select("id", "ids", "ns", "toks")
    both = pairs.join(body, "id").join(body.withColumnsRenamed({"id": "id2", "ids": "ids2", "ns": "ns2", "toks": "toks2"}), "id2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                v = [c[i].as_py() for c in b.columns]
                one, *two = [(np.frombuffer(x, np.int64), np.frombuffer(n, np.int64), _tokens(t)) for x, n, t in (v[k : k + 3] for k in range(0, len(v), 3))]
                x, y = group_pair_links(one, *(two or [one]), not two, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    within = body.where(F.length("ns") > 8).select("ids", "ns", "toks")  # of two sets or more
    across = both.select("ids", "ns", "toks", "ids2", "ns2", "toks2")
    return within.mapInArrow(run, "a long, b long").union(across.mapInArrow(run, "a long, b long"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (least key reachable by links of Jaccard
    similarity percent/100 or more between sets of ``words``-word shingles), class_size
    (rows with the same set).

    A text of fewer words has one shingle, its whole sequence. Null, empty and blank texts have no
    shingle, link to nothing and are their own component. Equal sets always link. A null key
    gets the least other key of its component, or null if there is none; repeated rows are each
    returned. Other columns are ignored; an empty table gives no rows.

    Equal sets are told by 128 bits, classes within links by 64 of them, shingles by 64 bits and
    in compared sets by 48: among N classes two share 64 bits with odds of about N*N / 2**65, and of n
    shingles in two compared sets two share 48 with odds of about n*n / 2**49.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    sets = ws.save(set_table(docs, key, text, words), "sets")
    levels = level_table(ws, sets)
    sets = ws.save(sets.drop("region"), "prints")
    ws.drop("sets")
    prefixes = ws.save(prefix_table(docs, key, text, words, percent, levels), "prefixes", "snappy")
    links = ws.save(light_links(ws, prefixes, percent), "light")
    links = ws.save(links.union(heavy_links(ws, prefixes, percent)), "links")
    ws.drop("prefixes", "heavy", "groups")
    comp = ws.save(components(ws, links).withColumnRenamed("node", "f1"), "components")
    classes = ws.save(sets.where("n > 0").groupBy("f1", "f2").agg(F.min("_key").alias("least"), F.count("*").alias("class_size")), "classes")
    joined = classes.join(comp, "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    joined = ws.save(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = ws.save(joined.join(least, "root").select("f1", "f2", "component_id", "class_size"), "of")
    out = sets.join(of, ["f1", "f2"], "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_key")).alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of similar texts: that of the least key (nulls last), the
    first in the input among equal ones. Rows without words all stay; columns stay as they are."""
    ws = Workspace(docs.sparkSession, "near")
    rid, by = free_name(docs, "_rid"), "_by"
    rows = ws.save(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(rid).alias("rid"))
    found = jaccard_components(rows.select(place.alias(by), F.col(text).alias("text")), by, "text", words, percent)
    gone = found.where(F.col(by)["rid"] != F.col("component_id")["rid"]).select(F.col(by)["rid"].alias(rid))
    # written, so that its size is known and the rows are dealt out only where it is large
    return rows.join(ws.save(gone, "gone"), rid, "left_anti").select(docs.columns)
