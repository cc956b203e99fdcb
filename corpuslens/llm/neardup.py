"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles. In each of several independent trees a document walks from the root:
in a node it picks the tokens of its set that are least under the node's own hash (BRANCH[level] of them) and goes on
to the child that each names, so similar sets share children and others part. What a document picks depends on its own
set and the node only, so the first levels are walked where the document is read. Documents with equal sets are one
vertex from then on.

Nodes of up to SMALL members are compared exhaustively. In larger ones every member is compared with one pivot; what
that links is contracted. Nodes that still hold several components are compared exhaustively across these, in blocks;
those of more than WIDE blocks go on to the next levels first. Pairs are compared by a sketch (the least hash of each of
BINS ranges, in a byte) and those that aren't far below the similarity by their full sets. The number of trees follows
from the similarity and the recall asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import textarrays as ta
from corpuslens.llm.arrowmap import with_columns
from corpuslens.operators.components import connected_components
from corpuslens.runtime import materialise

BRANCH = (2, 2, 1, 1)
#: What a further descent adds, and how many there are before blocks are compared.
DEEPER, DESCENTS = (2, 2), 2
SMALL, BLOCK, WIDE = 24, 500, 16
RECALL = 0.999999
#: Nodes with more than one HOT-th of the members are joined apart; there are fewer than HOT of them.
HOT = 1000
#: Bytes of a sketch; pairs whose estimate is MARGIN (five standard deviations) below the similarity are left out, if both
#: sets have more than FEW shingles: of smaller ones too few ranges are filled.
BINS, MARGIN, FEW = 256, 0.125, 64


def shared_picks(similarity: float, picks: int) -> list[float]:
    """Chances that two sets of this Jaccard similarity share 0, 1, ... of their picks least tokens."""
    out, states = [0.0] * (picks + 1), {(0, 0, 0): 1.0}
    while states:
        following: dict = {}
        for (a, b, s), p in states.items():
            if a == picks and b == picks:
                out[s] += p
                continue
            moves = [((min(a + 1, picks), min(b + 1, picks), s + (a < picks and b < picks)), similarity), ((min(a + 1, picks), b, s), (1 - similarity) / 2), ((a, min(b + 1, picks), s), (1 - similarity) / 2)]
            stay = sum(q for to, q in moves if to == (a, b, s))
            for to, q in moves:
                if to != (a, b, s):
                    following[to] = following.get(to, 0) + p * q / (1 - stay)
        states = following
    return out


def trees_for(similarity: float, recall: float = RECALL, branch: tuple[int, ...] = BRANCH + DESCENTS * DEEPER) -> int:
    """Trees after which a pair of this similarity has met in a last node with probability recall, also where all descents are made."""
    miss = 0.0
    for picks in reversed(branch):
        miss = sum(p * miss**k for k, p in enumerate(shared_picks(similarity, picks)))
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of k words, sorted within each text, and the offsets of the texts in them.

    Words are runs of other than white space (ASCII), A-Z taken as a-z; a text of fewer words has them all as one shingle.
    Words and shingles are told apart by hashes of 64 bits.
    """
    n = len(offsets) - 1
    starts, ends, doc = ta.words(data, offsets, ta.NOT_SPACE)
    hashes = ta.word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    width = np.minimum(count, k)
    many = np.where(count > 0, count - width + 1, 0)
    of = np.repeat(np.arange(n), many)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    value = width[of].astype(np.uint64)
    for j in range(k):
        there = j < width[of]
        value = np.where(there, ta.mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at + j, len(hashes) - 1)]), value) if len(hashes) else value
    order = np.argsort(value)
    order = order[np.argsort(of[order], kind="stable")]
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def walk(values: np.ndarray, offsets: np.ndarray, nodes: list[np.ndarray], alive: list[np.ndarray], branch: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From a node per set, the nodes some levels on. Sets are not empty; alive: whether a set is in its node."""
    sizes, starts = np.diff(offsets), offsets[:-1]
    for picks in branch:
        below, live = [], []
        for node, there in zip(nodes, alive, strict=True):
            score = ta.mix(values ^ np.repeat(node, sizes))
            for i in range(picks):
                least = np.minimum.reduceat(score, starts)
                below.append(ta.mix(node * np.uint64(3) + least))
                live.append(there & (sizes > i))
                if i + 1 < picks:
                    score[score == np.repeat(least, sizes)] = np.uint64(2**64 - 1)
        nodes, alive = below, live
    return nodes, alive


def sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each set, from the least hash in each of BINS ranges, a byte from 1; 0 for a range without any. Hashes are sorted within sets."""
    out = np.zeros((len(offsets) - 1, BINS), np.uint8)
    if len(values):
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        cell = row * BINS + (values >> np.uint64(56)).astype(np.int64)
        head = np.flatnonzero(np.diff(cell, prepend=-1))
        out.reshape(-1)[cell[head]] = (ta.mix(values[head]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of the Jaccard similarities of a sketch (or one for each row) with others: equal ranges among those that aren't both empty."""
    there = (one != 0) | (others != 0)
    return ((one == others) & there).sum(-1) / np.maximum(there.sum(-1), 1)


def roots(trees: int) -> np.ndarray:
    return ta.mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _fingerprints(docs: DataFrame, k: int, trees: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list:
        n_out, one, two, keys, drawn = [], [], [], [], []
        for _, _, data, offsets in ta.pieces(batch.column("text")):
            values, at = shingle_sets(data, offsets, k)
            size = np.diff(at)
            full = np.flatnonzero(size)
            inner = np.concatenate([at[full], at[-1:]])
            d1, d2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            found = np.zeros((len(size), 0), np.uint64)
            live = np.zeros((len(size), 0), bool)
            if len(full):
                d1[full] = np.add.reduceat(ta.mix(values ^ np.uint64(0xA5A5A5A5)), at[full])
                d2[full] = np.add.reduceat(ta.mix(values + np.uint64(0x5A5A5A5A5A)), at[full])
                nodes, alive = [], []
                for root in roots(trees):
                    x, y = walk(values, inner, [np.full(len(full), root)], [np.ones(len(full), bool)], BRANCH)
                    nodes, alive = nodes + x, alive + y
                found, live = np.zeros((len(size), len(nodes)), np.uint64), np.zeros((len(size), len(nodes)), bool)
                found[full], live[full] = np.stack(nodes, 1), np.stack(alive, 1)
            n_out.append(size)
            raw = sketches(values, at).tobytes()
            drawn += [raw[i : i + BINS] for i in range(0, len(raw), BINS)]
            one.append(d1.view(np.int64))
            two.append(d2.view(np.int64))
            lengths = live.sum(1)
            keys.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(found.view(np.int64)[live])))
        if not n_out:
            return [[], [], [], [], []]
        return [np.concatenate(n_out).tolist(), np.concatenate(one).tolist(), np.concatenate(two).tolist(), pa.concat_arrays(keys).cast(pa.list_(pa.int64())), drawn]

    return with_columns(docs.select("doc_id", "text"), "n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, sketch binary", make).drop("text")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, items (sorted 64-bit hashes) of the documents with these ids. Texts are shuffled once, whatever the number of ids."""

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for _, _, data, offsets in ta.pieces(batch.column("text")):
            values, at = shingle_sets(data, offsets, k)
            raw, at = memoryview(values.tobytes()), at.tolist()
            out += [bytes(raw[8 * a : 8 * b]) for a, b in zip(at, at[1:], strict=False)]
        return [out]

    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(materialise(ids, "ids").hint("merge"), "id", "left_semi")
    return materialise(with_columns(wanted, "items binary", make).drop("text"), "sets")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _near(edges: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sketches don't rule them out."""
    ends = [drawn.select(F.col("id").alias(e), F.col("sketch").alias(f"sketch_{e}"), F.col("n").alias(f"n_{e}")) for e in "ab"]
    both = edges.join(ends[1], "b").join(ends[0], "a").select("a", "b", "sketch_a", "sketch_b", F.least("n_a", "n_b").alias("n"))

    def make(batch: pa.RecordBatch) -> list:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
        return [((estimates(x, y) >= percent / 100 - MARGIN) | (batch.column(4).to_numpy() <= FEW)).tolist()]

    return materialise(with_columns(both, "near boolean", make).where("near").select("a", "b"), "near")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar."""
    both = edges.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")

    def make(batch: pa.RecordBatch) -> list:
        return [[similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]]

    return materialise(with_columns(both, "linked boolean", make).where("linked").select("a", "b"), "links")


def _met(members: DataFrame, stats: DataFrame) -> DataFrame:
    """members with what stats (node, c: its members, and more) says of their node, if anything.

    Nodes with more than one HOT-th of all members are so few that they are sent to every task: no task gathers one.
    """
    stats = materialise(stats, "stats")
    large = F.col("c") > (stats.agg(F.sum("c")).first()[0] or 0) / HOT
    hot = F.broadcast(stats.where(large))
    cold = members.join(hot.select("node"), "node", "left_anti").join(stats.where(~large), "node")
    return members.join(hot, "node").unionByName(cold)


def _candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """From node, id, n, comp: pairs to compare, and the members of nodes of more than SMALL."""
    stats = nodes.groupBy("node").agg(F.count("*").alias("c"), F.min("id").alias("pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("c > 1 AND lo <> hi").drop("lo", "hi")
    met = materialise(_met(nodes, stats), "nodes")
    small = met.where(F.col("c") <= SMALL).groupBy("node").agg(F.collect_list(F.struct("id", "n", "comp")).alias("all"))
    pairs = small.select(F.explode("all").alias("p"), "all").select("p", F.explode("all").alias("q")).where("p.id < q.id AND p.comp <> q.comp")
    pairs = pairs.where(100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    big = met.where(F.col("c") > SMALL)
    return pairs.union(big.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))).distinct(), big.select("node", "id", "n")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    comps = connected_components(links)
    return members.join(comps, "id", "left").select("node", "id", "n", F.coalesce("component", "id").alias("comp"))


def _open(members: DataFrame) -> DataFrame:
    """Members of the nodes that hold several components, with the number of blocks of their node, the blocks they are dealt from and meet.

    Members of a node's largest component have blocks of their own after those of the others, which are all they meet: a
    group that is one component already isn't compared with itself.
    """
    members = materialise(members, "labelled")
    sizes = members.groupBy("node", "comp").agg(F.count("*").alias("of"))
    stats = sizes.groupBy("node").agg(F.sum("of").alias("c"), F.max(F.struct("of", (-F.col("comp")).alias("minus"))).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    others = F.ceil((F.col("c") - F.col("most.of")) / BLOCK)
    # nodes of one block are compared as that
    stats = stats.withColumn("others", F.when(F.col("c") <= BLOCK, 1).otherwise(others).cast("bigint")).withColumn("main", F.when(F.col("c") > BLOCK, -F.col("most.minus")))
    stats = stats.withColumn("own", F.when(F.col("c") > BLOCK, F.ceil(F.col("most.of") / BLOCK)).otherwise(0).cast("bigint")).drop("most", "comps")
    met = _met(members, stats).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("bigint"))
    mine = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    block = F.when(mine, F.col("others") + F.pmod(F.xxhash64("id"), F.greatest("own", F.lit(1).cast("bigint")))).otherwise(F.pmod(F.xxhash64("id"), "others"))
    return materialise(met.select("node", "id", "n", "comp", "blocks", block.alias("i"), F.when(mine, F.col("others")).otherwise(F.col("others") + F.col("own")).alias("meets")), "open")


def _descend(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of open nodes, in the nodes some levels on."""

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for node, items in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
            values = np.frombuffer(items.as_buffer(), np.uint64)
            at = np.array([0, len(values)])
            nodes, alive = walk(values, at, [np.array([node], np.int64).view(np.uint64)], [np.ones(1, bool)], DEEPER)
            out.append([int(x.view(np.int64)[0]) for x, y in zip(nodes, alive, strict=True) if y[0]])
        return [out]

    below = with_columns(members.join(sets, "id"), "below array<bigint>", make)
    return materialise(below.select(F.explode("below").alias("node"), "id", "n", "comp"), "below")


def _across(members: DataFrame, drawn: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a node that are of different components, block by block.

    A first pass over sketches and sizes lists each member's possible partners; a pair is left to the first of the nodes
    that its ends share. Members with any then meet with their full sets, so pairs never become rows.
    """
    # a document is in a few nodes of each tree, so sketches are joined to documents and not to their places in nodes
    mine = members.groupBy("id", "n", "comp").agg(F.collect_list(F.struct("node", "i", "meets")).alias("places")).join(drawn.drop("n"), "id")
    placed = mine.select("id", "n", "comp", "sketch", F.array_distinct("places.node").alias("keys"), F.explode("places").alias("at")).select("*", "at.*")
    dealt = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("meets") - 1)))
    dealt = dealt.select("node", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "id", "n", "comp", "sketch", "keys")

    def meet(key, pdf):
        import pandas as pd

        drawn, comp, n, block, ids = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, BINS), pdf["comp"].to_numpy(), pdf["n"].to_numpy(), pdf["i"].to_numpy(), pdf["id"].to_numpy()
        width = max(map(len, pdf["keys"]))
        # padded by the rows' own numbers, negative and far from one another: they match nothing
        keys = np.stack([np.concatenate([x, np.full(width - len(x), -(2**63) + s)]) for s, x in enumerate(pdf["keys"])]).astype(np.int64)
        partners: list[list[int]] = [[] for _ in ids]
        wanted = np.zeros(len(ids), bool)
        for s in range(len(ids) - 1):
            x = slice(s + 1, None)
            some = (comp[x] != comp[s]) & (100 * np.minimum(n[x], n[s]) >= percent * np.maximum(n[x], n[s]))
            if key[1] != key[2]:
                some &= block[x] != block[s]
            at = s + 1 + np.flatnonzero(some)
            if len(at):
                at = at[(estimates(drawn[s], drawn[at]) >= percent / 100 - MARGIN) | (np.minimum(n[at], n[s]) <= FEW)]
            if len(at):
                shared = np.isin(keys[at], keys[s])
                at = at[np.where(shared, keys[at], 2**63 - 1).min(1) >= key[0]] if shared.any() else at
            if len(at):
                partners[s] = ids[at].tolist()
                wanted[s] = wanted[at] = True
        return pd.DataFrame({"node": key[0], "p": key[1], "q": key[2], "id": ids[wanted], "comp": comp[wanted], "partners": pd.Series([partners[s] for s in np.flatnonzero(wanted)], dtype=object)})

    listed = materialise(dealt.groupBy("node", "p", "q").applyInPandas(meet, "node bigint, p bigint, q bigint, id bigint, comp bigint, partners array<bigint>"), "partners")

    def compare(pdf):
        import pandas as pd

        items, at, found = dict(zip(pdf["id"], pdf["items"], strict=True)), dict(zip(pdf["id"], pdf["comp"], strict=True)), []
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        for a, partners in zip(pdf["id"], pdf["partners"], strict=True):
            for b in partners:
                x, y = root(at[a]), root(at[b])
                if x != y and similar(items[a], items[b], percent):
                    up[max(x, y)] = min(x, y)
                    found.append((min(a, b), max(a, b)))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    full = listed.groupBy("id").agg(F.collect_list(F.struct("node", "p", "q", "comp", "partners")).alias("all")).join(sets, "id").select("id", "items", F.inline("all"))
    return materialise(full.groupBy("node", "p", "q").applyInPandas(compare, "a bigint, b bigint"), "across")


def _linked(docs: DataFrame, known: DataFrame | None, words: int, percent: int, recall: float) -> DataFrame:
    """Row of docs (doc_id, none repeated but null, and text) -> doc_id, n_shingles, component; known: links a, b that are there anyway."""
    base = materialise(_fingerprints(docs, words, trees_for(percent / 100, recall)), "fingerprints")
    same = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    mapped = base.join(same, ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", "rep", *[F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("keys", "sketch")])
    mapped = materialise(mapped, "classes")
    chosen = mapped.where("keys IS NOT NULL")
    drawn = chosen.select(F.col("rep").alias("id"), "sketch", F.col("n_shingles").alias("n"))
    nodes = chosen.select(F.explode(F.array_distinct("keys")).alias("node"), F.col("rep").alias("id"), F.col("n_shingles").alias("n")).withColumn("comp", F.col("id"))
    links = sets = None
    for level in range(DESCENTS + 1):
        pairs, big = _candidates(nodes, percent)
        near = _near(pairs, drawn, percent)
        if sets is None:
            # further levels have members of these nodes only
            sets = _sets(docs, near.select(F.explode(F.array("a", "b")).alias("id")).union(big.select("id")).distinct(), words)
        found = _confirmed(near, sets, percent)
        links = found if links is None else links.union(found)
        if big.isEmpty():
            break
        rest = _open(_labelled(big, links))
        if rest.isEmpty():
            break
        narrow = rest if level == DESCENTS else rest.where(F.col("blocks") <= WIDE)
        links = links.union(_across(narrow, drawn, sets, percent))
        wide = rest.where(F.col("blocks") > WIDE)
        if level == DESCENTS or wide.isEmpty():
            break
        nodes = _descend(_labelled(wide.select("node", "id", "n"), links), sets)
    joined = links if known is None else links.union(_between(known, mapped))
    comps = connected_components(joined).select(F.col("id").alias("at"), "component")
    out = mapped.drop("keys", "sketch").withColumn("at", F.coalesce("rep", "doc_id")).join(comps, "at", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "at")).alias("component"))


def _between(known: DataFrame, mapped: DataFrame) -> DataFrame:
    """Links of documents as links of those that stand for their sets (of themselves, if they have no shingle)."""
    stands = mapped.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    for end in "ab":
        known = known.join(stands.withColumnRenamed("doc_id", end), end).drop(end).withColumnRenamed("rep", end)
    return known.select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """Row of docs -> doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is the document's own).

    docs: doc_id (integer), text; other columns are ignored. Two documents are linked if 100 * intersection >= percent *
    union of their sets of distinct shingles of so many words. Null texts and texts without words have an empty set and
    are linked with nothing; a text of fewer words is one shingle. A null doc_id is linked with nothing and kept, its
    component null. Rows that repeat a doc_id count as one vertex that has the links of all their texts; each is
    reported with the size of its own set. An empty table gives no row.
    """
    docs = docs.select("doc_id", "text")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        out = _linked(docs, None, words, percent, recall)
    else:
        # each row is a document of its own, linked with the first of its doc_id
        rows = materialise(docs.select(F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row"), "doc_id", "text"), "rows")
        names = rows.where("row IS NOT NULL").select("row", "doc_id")
        first = names.groupBy("doc_id").agg(F.min("row").alias("a"))
        known = materialise(names.join(first, "doc_id").where("row <> a").select("a", F.col("row").alias("b")), "repeated")
        found = materialise(_linked(rows.select(F.col("row").alias("doc_id"), "text"), known, words, percent, recall).withColumnRenamed("doc_id", "row").join(names, "row", "left"), "linked")
        least = found.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
        out = found.join(least, "component", "left").select("doc_id", "n_shingles", F.col("least").alias("component"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with their own columns."""
    dropped = near_duplicates(docs, words, percent, recall).where("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
