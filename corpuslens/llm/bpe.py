"""Byte-level BPE with a hierarchical-bitmap rank queue.

All pre-tokens of a slice of texts that this worker hasn't met lately are laid side by side in one byte buffer. A
linked list runs through its tokens; for each merge rank a bucket holds the list positions whose pair has that rank,
and a three-level bitmap over the ranks finds the next one by find-first-set. Entries whose pair has changed meanwhile
are stale and skipped. A merge costs the same in a pre-token of ten bytes and of ten million.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.arrowmap import Recent, with_columns, without

#: Bytes that a worker spends on the pre-tokens that it has met, characters (or bytes of ids) in a slice, and pre-tokens
#: of a longer text that are taken at once.
KEPT, SLICE, MANY = 48 << 20, 1 << 20, 200_000
#: Places from which on a bucket is merged by array operations.
WIDE = 24


def slices(values: list, limit: int) -> Iterator[list]:
    """values in lists of at most so many characters or bytes, or of one."""
    some, size = [], 0
    for x in values:
        if some and size + len(x) > limit:
            yield some
            some, size = [], 0
        some.append(x)
        size += len(x)
    if some:
        yield some


def heads_of(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


class RankQueue:
    """Buckets of positions by rank, and which of them hold anything."""

    def __init__(self, n: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0

    def add(self, rank: int, positions: list[int]) -> None:
        if rank in self.buckets:
            self.buckets[rank] += positions
            return
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that has a bucket, and its positions from the left; they leave the queue."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) | ((self.mid[a] & -self.mid[a]).bit_length() - 1)
        rank = (b << 6) | ((self.low[b] & -self.low[b]).bit_length() - 1)
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Vocabulary:
    """Ranks of a .tiktoken file; a token's rank is its id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.pattern = regex.compile(pattern)
        tokens = sorted((rank, token) for token, rank in self.ranks.items())
        self.length = np.zeros(self.size, np.int64)
        self.length[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.pair = np.full(1 << 16, self.size, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank
        pairs = np.array([(x, y, rank) for rank, token in tokens for i in range(1, len(token)) if (x := self.ranks.get(token[:i])) is not None and (y := self.ranks.get(token[i:])) is not None], np.int64).reshape(-1, 3)
        #: where the pairs of each token as the left (right) one begin, their other tokens in ascending order, and their ranks
        self.by_left, self.by_right = (self._table(pairs[:, k], pairs[:, 1 - k], pairs[:, 2]) for k in (0, 1))
        self.kept = Recent(KEPT)

    def _table(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((other, own))
        return np.searchsorted(own[order], np.arange(self.size + 1)), other[order], rank[order]

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each of some byte strings, merged by rank, the leftmost of equal ranks first; little-endian unsigned 32-bit integers."""
        out = [b""] * len(parts)
        todo = []
        for i, part in enumerate(parts):
            whole = self.ranks.get(part)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif part:
                todo.append(i)
        if not todo:
            return out
        self._merge_all(todo, parts, out)
        return out

    def _merge_all(self, todo: list[int], parts: list[bytes], out: list[bytes]) -> None:
        """Fill in out for those of parts that todo names.

        Pre-tokens don't depend on one another. Of a bucket of many places, the first place of each pre-token is merged by
        array operations; what is left of it, and small buckets, place by place.
        """
        buf = b"".join(parts[i] for i in todo)
        n, none = len(buf), self.size
        lengths = np.array([len(parts[i]) for i in todo])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(buf, np.uint8)
        #: by place: the token there (-1: inside one), the next and the previous token's place, the rank of the pair that begins there
        token, after, before = self.single[data], np.arange(1, n + 1), np.arange(-1, n)
        rank = np.full(n, none, np.int64)
        first = np.zeros(n + 1, bool)
        first[starts] = True
        rank[:-1] = self.pair[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[:-1][first[1:n]] = none
        part = np.repeat(np.arange(len(todo)), lengths)
        queue = RankQueue(self.size)
        self._push(queue, np.arange(n), rank)
        get, add, none = self.ranks.get, queue.add, self.size
        tokens, nexts, previous, of, firsts = map(memoryview, (token, after, before, rank, first))
        while (entry := queue.pop()) is not None:
            r, bucket = entry
            if len(bucket) >= WIDE:
                # one merge in each pre-token that the bucket has, all at once
                p = np.array(bucket)
                p = p[rank[p] == r]
                head = heads_of(part[p])
                bucket = p[~head].tolist()
                p = p[head]
                m = after[p]
                e = after[m]
                token[p], token[m], rank[m] = r, -1, none
                after[p], before[e] = e, p
                rank[p] = none
                right, left = ~first[e], ~first[p]
                pr, pl = p[right], before[p[left]]
                rank[pr] = found = self._pairs(self.by_left, r, token[e[right]])
                rank[pl] = other = self._pairs(self.by_right, r, token[pl])
                least = self._push(queue, np.concatenate([pr, pl]), np.concatenate([found, other]))
                if least < r and bucket:
                    add(r, bucket)
                    continue
            for k, p in enumerate(bucket):
                if of[p] != r:
                    continue  # stale
                m = nexts[p]
                e = nexts[m]
                tokens[p], tokens[m], of[m] = r, -1, none
                nexts[p], previous[e] = e, p
                least = r
                if firsts[e]:
                    of[p] = none
                else:
                    q = of[p] = get(buf[p : nexts[e]], none)
                    if q != none:
                        add(q, [p])
                        if q < r:
                            least = q
                if not firsts[p]:
                    b = previous[p]
                    q = of[b] = get(buf[b:e], none)
                    if q != none:
                        add(q, [b])
                        if q < r:
                            least = q
                if least < r:  # a lower rank has come up: it goes first
                    if rest := bucket[k + 1 :]:
                        add(r, rest)
                    break
        left = token >= 0
        cuts = [0, *(4 * np.cumsum(np.add.reduceat(left, starts[:-1], dtype=np.int64))).tolist()]
        raw = token[left].astype("<u4").tobytes()
        for i, a, b in zip(todo, cuts, cuts[1:], strict=False):
            out[i] = raw[a:b]

    def _push(self, queue: RankQueue, places: np.ndarray, ranks: np.ndarray) -> int:
        """Put places into the buckets of their ranks; the least rank."""
        order = np.argsort(ranks, kind="stable")
        order = order[: np.searchsorted(ranks[order], self.size)]
        ranks, places = ranks[order], places[order].tolist()
        heads = np.flatnonzero(heads_of(ranks))
        bounds = [*heads.tolist(), len(places)]
        for r, a, b in zip(ranks[heads].tolist(), bounds, bounds[1:], strict=False):
            queue.add(r, places[a:b])
        return int(ranks[0]) if len(ranks) else self.size

    def _pairs(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of a token with others, by table; size for those that have none."""
        bounds, other, rank = table
        a, b = bounds[token], bounds[token + 1]
        if a == b:
            return np.full(len(others), self.size)
        at = a + np.minimum(np.searchsorted(other[a:b], others), b - a - 1)
        return np.where(other[at] == others, rank[at], self.size)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for some in slices(texts, SLICE):
            if len(some[0]) <= SLICE:
                out += self.joined([self.split(t) for t in some])
                continue
            found, done = self.pattern.finditer(some[0]), []
            while part := [m.group() for m in islice(found, MANY)]:
                done += self.joined([part])
            out.append(b"".join(done))
        return out

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)

    def joined(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens."""
        self.learn(set().union(*split))
        get = self.kept.young.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def learn(self, parts: set[str]) -> None:
        """Keep the ids of these pre-tokens."""
        new = self.kept.missing(parts)
        self.kept.add(new, self.merge([p.encode() for p in new]))

    def decode(self, many: list[bytes]) -> list[bytes]:
        """Of each list of ids, as encode() gives them, the bytes it stands for."""
        out: list[bytes] = []
        for some in slices(many, SLICE):
            ids = np.frombuffer(b"".join(some), "<u4")
            length = self.length[ids]
            stops = np.cumsum(length)
            data = self.flat[np.repeat(self.offset[ids] - (stops - length), length) + np.arange(length.sum())].tobytes()
            cuts = np.concatenate([[0], stops])[np.cumsum([0] + [len(x) // 4 for x in some])].tolist()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """A worker keeps a vocabulary between its tasks, but not the pre-tokens that it has met."""
    return Vocabulary(path, pattern)


def _free(docs: DataFrame, *names: str) -> None:
    if taken := [n for n in names if len(without(docs, n).columns) < len(docs.columns)]:
        raise ValueError(f"docs has columns {taken} already")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of token ids (little-endian unsigned 32-bit integers), as the tiktoken library gives them.

    path: a .tiktoken file of ranks, on every machine; pattern: what a pre-token is. Special tokens are ordinary text.
    Null and empty texts have no ids; rows, repeated ones too, and other columns stay as they are. A column already
    called as ids must be dropped or renamed first.
    """
    _free(docs, ids)

    def make(batch: pa.RecordBatch) -> list:
        return [vocabulary(path, pattern).encode(pc.fill_null(batch.column(text), "").to_pylist())]

    return with_columns(docs, f"`{ids}` binary", make, lambda: vocabulary(path, pattern).kept.clear())


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() of its ids, by one worker for a batch. Columns already called so must be dropped or renamed first."""
    _free(docs, ids, decoded)

    def make(batch: pa.RecordBatch) -> list:
        v = vocabulary(path, pattern)
        encoded = v.encode(pc.fill_null(batch.column(text), "").to_pylist())
        return [encoded, v.decode(encoded)]

    return with_columns(docs, f"`{ids}` binary, `{decoded}` binary", make, lambda: vocabulary(path, pattern).kept.clear())


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with a binary column of the bytes that the ids stand for; null for null. A column already called so must be dropped or renamed first."""
    _free(docs, decoded)

    def make(batch: pa.RecordBatch) -> list:
        column = batch.column(ids)
        out = vocabulary(path, pattern).decode(pc.fill_null(column, b"").to_pylist())
        return [[x if there else None for x, there in zip(out, column.is_valid().to_pylist(), strict=True)]]

    return with_columns(docs, f"`{decoded}` binary", make)


def count(ids: str = "ids"):
    """How many ids a column of encode() holds."""
    return F.floor(F.octet_length(ids) / 4).cast("bigint")
