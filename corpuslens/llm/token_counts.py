"""Token counts that follow edits.

A document keeps a segment tree over blocks of its pre-tokens, with sums of characters and tokens. An edit finds its
pre-tokens by descending the tree, re-splits the text from a few characters before the edit until a new pre-token begins
where an old one did, encodes only those, and updates the sums above their blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import bpe
from corpuslens.llm.arrowmap import Recent, with_columns, without

#: Pre-tokens in a block at first, and how many it may have before the tree is laid out anew.
BLOCK, CROWDED = 32, 2048
#: The pattern looks at most so many characters beyond a pre-token's end.
CONTEXT = 4
#: Bytes that a worker spends on the pre-tokens that it has met, and characters of text in a slice.
KEPT, SLICE = 64 << 20, 1 << 20

EDITS = "array<struct<skip:bigint,remove:bigint,insert:string>>"


class Counter:
    """Numbers of tokens of pre-tokens; a worker keeps those it has met."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = bpe.vocabulary(path, pattern)
        self.kept = Recent(KEPT)

    def learn(self, parts: set[str]) -> None:
        new = self.kept.missing(parts)
        self.kept.add(new, [len(ids) // 4 for ids in self.vocabulary.merge([p.encode() for p in new])])

    def split(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Lengths and numbers of tokens of the pre-tokens of each text."""
        parts = [self.vocabulary.pattern.findall(t) for t in texts]
        self.learn(set().union(*parts))
        return [(list(map(len, x)), list(map(self.kept.young.__getitem__, x))) for x in parts]


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """Lengths and token numbers of pre-tokens in blocks, with their sums in a binary tree; node 1 is the root."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.blocks = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (a, b) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.blocks for x in a], [x for _, b in self.blocks for x in b]

    def find(self, place: int) -> tuple[int, int, int]:
        """Block, index in it and start of the pre-token at a character; of the last one for places beyond."""
        if place >= self.chars[1]:
            place = max(self.chars[1] - 1, 0)
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.width
        for i, n in enumerate(self.blocks[block][0]) if block < len(self.blocks) else []:
            if place < start + n:
                return block, i, start
            start += n
        return min(block, len(self.blocks) - 1), 0, start

    def put(self, block: int, lengths: list[int], tokens: list[int]) -> None:
        self.blocks[block] = (lengths, tokens)
        node = self.width + block
        dc, dt = sum(lengths) - self.chars[node], sum(tokens) - self.tokens[node]
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, text: str, start: int, end: int, insert: str, count: Counter) -> tuple[str, int]:
        """Replace text[start:end] by insert; the new text, and how many pre-tokens were encoded."""
        new = text[:start] + insert + text[end:]
        shift = len(insert) - (end - start)
        block, i, old = self.find(max(0, start - CONTEXT))
        first, kept = block, i
        at, found = old, []
        lengths = self.blocks[block][0]
        for m in count.vocabulary.pattern.finditer(new, at):
            at = m.start()
            # the old boundary at or beyond this place
            while old < at - shift and old < len(text):
                while i >= len(lengths):
                    block, i = block + 1, 0
                    lengths = self.blocks[block][0]
                old += lengths[i]
                i += 1
            if at - shift >= end and old == at - shift and at >= start + len(insert):
                break
            found.append(m.group())
        else:
            block, i = len(self.blocks) - 1, len(self.blocks[-1][0])
        count.learn(set(found))
        numbers = [count.kept.young[p] for p in found]
        head, tail = self.blocks[first], self.blocks[block]
        rest = (tail[0][i:], tail[1][i:])
        for b in range(first + 1, block + 1):
            self.put(b, [], [])
        self.put(first, head[0][:kept] + [len(p) for p in found] + rest[0], head[1][:kept] + numbers + rest[1])
        if len(self.blocks[first][0]) > CROWDED:
            self.__init__(*self.leaves())
        return new, len(found)

    def dump(self) -> bytes:
        lengths, tokens = self.leaves()
        both = np.array([lengths, tokens], np.uint32)
        kind = "<u1" if both.max(initial=0) < 256 else "<u4"
        return kind.encode() + both.astype(kind).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        lengths, tokens = np.frombuffer(data[3:], data[:3].decode()).reshape(2, -1).tolist()
        return cls(lengths, tokens)


def build(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with tree (binary) and n_tokens, by the ranks and pattern of bpe.encode(). Null texts are empty; columns of docs stay, but for earlier ones of these names."""

    def make(batch: pa.RecordBatch) -> list:
        trees, totals = [], []
        for some in bpe.slices(pc.fill_null(batch.column(text), "").to_pylist(), SLICE):
            for lengths, tokens in counter(path, pattern).split(some):
                trees.append(Tree(lengths, tokens).dump())
                totals.append(sum(tokens))
        return [trees, totals]

    return with_columns(without(docs, "tree", "n_tokens"), "tree binary, n_tokens bigint", make, lambda: counter(path, pattern).kept.clear())


def edit(docs: DataFrame, path: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """docs (text, tree, n_tokens, edits) with those of edits carried out: text, tree and n_tokens are the new ones, n_encoded
    counts the pre-tokens that were encoded for it.

    edits: for each, in order, how many characters of the old text to skip since the one before, how many to remove, and
    what to insert (null: nothing). Places beyond the end are the end. Null edits are none, a null text is empty.
    """
    names = [c for c in without(docs, "n_encoded").columns]

    def make(batch: pa.RecordBatch) -> list:
        count, out = counter(path, pattern), ([], [], [], [])
        for t, tree, todo in zip(batch.column(text).to_pylist(), batch.column("tree").to_pylist(), batch.column(edits).to_pylist(), strict=True):
            encoded = 0
            if todo:
                t, held = t or "", Tree.load(tree)
                places, at = [], 0
                for e in todo:
                    start = min(at + e["skip"], len(t))
                    at = min(start + e["remove"], len(t))
                    places.append((start, at, e["insert"] or ""))
                # from the right, so that places to the left stay what they are
                for start, end, insert in reversed(places):
                    t, n = held.edit(t, start, end, insert, count)
                    encoded += n
                tree = held.dump()
                total = held.total
            else:
                total = int(np.frombuffer(tree[3:], tree[:3].decode()).reshape(2, -1)[1].sum())
            for column, value in zip(out, (t, tree, total, encoded), strict=True):
                column.append(value)
        return list(out)

    done = with_columns(without(docs, "n_encoded"), "__text string, __tree binary, __n bigint, n_encoded bigint", make, lambda: counter(path, pattern).kept.clear())
    new = {text: "__text", "tree": "__tree", "n_tokens": "__n"}
    return done.select(*[F.col(new[c]).alias(c) if c in new else F.col(c) for c in names], "n_encoded")


def replacements(text: str, pattern: str, insert: str) -> Column:
    """Edits that put insert in place of every match of a pattern (Java's syntax, no empty matches)."""
    column = F.coalesce(F.col(text), F.lit(""))
    hits = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    return F.when(
        column.rlike(pattern),
        F.zip_with(hits, F.slice(F.split(column, pattern, -1), F.lit(1), F.size(hits)), lambda m, p: F.struct(F.char_length(p).cast("bigint").alias("skip"), F.char_length(m).cast("bigint").alias("remove"), F.lit(insert).alias("insert"))),
    ).otherwise(F.array().cast(EDITS))
