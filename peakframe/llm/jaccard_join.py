"""Similarity join of documents on the Jaccard index of their word n-grams, by a MinHash LSH forest.

Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case; a document is the set
of its five-word shingles (one shingle of all its words if it has fewer). Sets are held as 64-bit hashes, and documents
whose sets have the same 128-bit fingerprint are one class; only classes are compared.

Each of ``TREES`` trees orders the classes by a label of ``LONGEST`` MinHash values. Two classes that share a prefix of a label
meet in that node of the tree's prefix trie; a node is its prefix, so a level of all tries is a table, and walking up is an
equi-join. Matching begins with the longest prefixes and shortens them level by level. What meets is compared exactly, and
from the similarities found follows how many pairs such prefixes miss: a pair of similarity s meets under prefixes of d values
with probability 1 - (1 - s^d)^TREES, so each one found stands for the inverse of that. Once the measured recall reaches ``TARGET``
the walk ends; at the latest it ends at the depth where pairs at the threshold itself are met so often.

Each class has a home with those that have the same smallest class among all that they meet at first and those that these meet, or a
part of it, if they are many. Homes whose classes share a node are a block, and all of the block's classes that share one are compared with each other, by
exact verification, in one task's work; a pair belongs to the block of its two homes, so it counts once however often it meets.
Blocks that a shorter prefix makes larger are done again. Tasks return sums and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, let_go
from .common import batch, cut, map_arrow, texts

WIDTH, THRESHOLD, TREES, LONGEST, TARGET = 5, 0.8, 24, 8, 0.999
#: Shingles in a part of a home; a class counts as so many at least. Ways in which a node's rows are dealt.
PART, LEAST, SALTS = 200_000, 200, 4
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SEED = np.random.default_rng(20240607)
_ODD = _SEED.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _SEED.integers(0, 1 << 63, TREES * LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9DDFEA08EB382D69
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        step = np.full(size, np.uint64(_BASE))
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        _inverses = np.multiply.accumulate(step)
    return _powers, _inverses


_inverses = np.ones(1, np.uint64)


def word_hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8"), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], _WORD[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    power, inverse = _powers_to(len(b))
    total = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * power[: len(b)], dtype=np.uint64)])
    return mix((total[stop] - total[start]) * inverse[start])


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < width:
        return mix((w * _ODD[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - width + 1
    s = w[:n] * _ODD[0]
    for k in range(1, width):
        s = s + w[k : k + n] * _ODD[k]
    return np.unique(mix(s))


def labels(s: np.ndarray, trees: int = TREES, length: int = LONGEST) -> np.ndarray:
    """MinHash values, a row of ``length`` for each tree."""
    least = np.full(trees * length, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, np.multiply.outer(s[i : i + 1024], _MULTIPLIERS[: trees * length]).min(axis=0), out=least)
    return least.reshape(trees, length)


def prefix_keys(label: np.ndarray, shortest: int) -> list[list[int]]:
    """Keys of each tree's prefixes, the tree's number being part of them: a list for each depth, from the whole label to the shortest prefix."""
    key = np.arange(1, len(label) + 1, dtype=np.uint64)
    out = []
    for k in range(label.shape[1]):
        key = mix(key * np.uint64(_BASE) + label[:, k])
        if k + 1 >= shortest:
            out.append(key.view(np.int64).tolist())
    return out[::-1]


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    return 1 - (1 - similarity**depth) ** trees


def match_depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, target: float = TARGET) -> int:
    """The longest prefix that recalls a pair at the threshold as often as asked."""
    depth = longest
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def sketch(documents: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, size of the shingle set, its fingerprint (two longs), and prefix keys by depth, the longest prefixes first."""
    shortest = match_depth(threshold)
    fields = [("doc_id", pa.int64()), ("size", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.list_(pa.int64())))]

    def run(batches):
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py(), width)
                rows.append((d, len(s), *fingerprint(s), prefix_keys(labels(s), shortest)) if len(s) else (d, 0, None, None, None))
            if rows:
                yield batch(fields, list(zip(*rows, strict=True)))

    return map_arrow(texts(documents), run, "doc_id long, size long, f1 long, f2 long, keys array<array<long>>")


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s * _ODD[11]).sum().view(np.int64)), int(mix(s * _ODD[12] + np.uint64(1)).sum().view(np.int64))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, put together by their first columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the sets' intersections (the diagonal isn't filled)."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, owner = np.concatenate(sets)[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    count = np.diff(np.append(first, len(values)))
    out = np.zeros((m, m), np.int64)
    often = 48  # shingles in few sets are counted pair by pair, the others by matrix products
    rare = first[(count > 1) & (count <= often)]
    left = count[(count > 1) & (count <= often)]
    for k in range(1, often):
        rare, left = rare[left > k], left[left > k]
        if not len(rare):
            break
        width = np.arange(int(left.max()) - k)
        at = (rare[:, None] + width)[width < (left - k)[:, None]]
        a, b = owner[at], owner[at + k]
        out += np.bincount(np.minimum(a, b) * m + np.maximum(a, b), minlength=m * m).reshape(m, m)
    dense = np.flatnonzero(count > often)
    for i in range(0, len(dense), 2048):
        part = dense[i : i + 2048]
        x = np.zeros((m, len(part)), np.float32)
        for c, f in enumerate(part.tolist()):
            x[owner[first[f] : first[f] + count[f]], c] = 1
        out += np.triu(np.rint(x @ x.T).astype(np.int64), 1)
    return out + out.T


def forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix: the smallest id that it reaches."""
    least = ids.copy()
    while True:
        reached = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(least, reached)
        if (new == least).all():
            return least
        least = new


def shared_nodes(classes: DataFrame, level: int) -> DataFrame:
    """key, rep, its weight, and the node's hub (its smallest class), for each class and each node that it shares with others at that level (0: whole labels)."""
    at = classes.select(F.explode(F.element_at("keys", level + 1)).alias("key"), "rep", "weight").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    nodes = at.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("hub")).where("c > 1")
    nodes = nodes.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))  # a node of a third of all classes is several tasks' rows
    return at.join(nodes, ["key", "salt"]).select("key", "rep", "weight", "hub")


def homes_of(at: DataFrame, level: int) -> DataFrame:
    """rep, home: classes with the same smallest hub among their nodes' and those of the others there, in parts by weight.

    One step further than the own nodes' hubs brings nearly all of a group of near copies together, whatever trees they meet in.
    """
    first = at.groupBy("rep").agg(F.min("hub").alias("first"))
    wider = at.select("key", "rep").join(first, "rep").groupBy("key").agg(F.min("first").alias("hub"))
    wider = wider.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    own = at.select("key", "rep", "weight").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).join(wider, ["key", "salt"])
    own = own.groupBy("rep", "weight").agg(F.min("hub").alias("hub")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    parts = own.groupBy("hub").agg(F.ceil(F.sum("weight") / PART).alias("parts"), F.array(*[F.lit(k).cast("long") for k in range(SALTS)]).alias("salts"))
    placed = own.join(parts.select("hub", "parts", F.explode("salts").alias("salt")), ["hub", "salt"])
    return placed.select("rep", F.xxhash64("hub", F.pmod(F.xxhash64("rep"), F.col("parts")), F.lit(level)).alias("home"))


def blocks(at: DataFrame, homes: DataFrame) -> DataFrame:
    """a, b, rep, home: for each pair of homes a <= b that share a node, their classes that are in one.

    Nodes with the same homes are one for this: a group that meets in every tree is dealt once, not once a tree.
    """
    placed = cut(at.select("key", "rep").join(homes, "rep"))
    inside = placed.select("key", "home").distinct()
    alike = cut(inside.groupBy("key").agg(F.bit_xor(F.xxhash64("home")).alias("s1"), F.bit_xor(F.xxhash64("home", F.lit(1))).alias("s2"), F.collect_set("home").alias("homes")))  # a home is some PART of a node
    members = placed.join(alike.select("key", "s1", "s2"), "key").select("s1", "s2", "home", "rep").distinct()
    once = alike.groupBy("s1", "s2").agg(F.first("homes").alias("homes"))
    sides = once.select("s1", "s2", F.explode("homes").alias("home"), F.col("homes").alias("others")).select("s1", "s2", "home", F.explode("others").alias("other"))
    rows = members.join(sides, ["s1", "s2", "home"])
    return rows.select(F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), "rep", "home").distinct()


_RESULT = "a long, b long, rep long, links long, hub long, found double, stand_for array<double>"


def compare(rows: DataFrame, classes: DataFrame, payload: DataFrame, threshold: float, width: int, depths: list[int]) -> DataFrame:
    """Compare the classes of each block: within it if a = b, else those of the one home with those of the other.

    Returns rep, links (rows of other classes linked to it) and hub, the smallest rep of its links' component within the block; a
    block's first row tells the pairs found, and for each depth how many pairs they stand for.
    """
    full = rows.join(classes.select("rep", "n", "f1", "f2"), "rep").join(payload, "rep")
    full = full.select("a", "b", "rep", "home", "n", "f1", "f2", "text").repartition("a", "b").sortWithinPartitions("a", "b", "rep")
    fields = [("a", pa.int64()), ("b", pa.int64()), ("rep", pa.int64()), ("links", pa.int64()), ("hub", pa.int64()), ("found", pa.float64()), ("stand_for", pa.list_(pa.float64()))]

    def run(batches):
        out = []
        for group in grouped(batches, 2):
            a, b = group[0][:2]
            sets, kept, seen = [], [], set()
            for row in group:
                _, _, rep, home, n, f1, f2, text = row
                s = shingles(text, width)
                if (f1, f2) not in seen and len(s) and fingerprint(s) == (f1, f2):  # a doc_id may stand for several texts
                    seen.add((f1, f2))
                    sets.append(s)
                    kept.append((rep, home, n))
            if len(kept) < 2:
                continue
            sizes, common = np.array([len(s) for s in sets]), overlaps(sets)
            linked = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
            ids, home, n = (np.array(x) for x in zip(*kept, strict=True))
            if a != b:
                linked &= home[:, None] != home[None, :]
            np.fill_diagonal(linked, False)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                x, y = np.nonzero(np.triu(linked))
                similarity = common[x, y] / (sizes[x] + sizes[y] - common[x, y])
                told = (float(len(x)), [float((1 / recall(similarity, d)).sum()) for d in depths])
                sums, hubs = linked @ n, forest(linked, ids)
                for k in some.tolist():
                    out.append((a, b, int(ids[k]), int(sums[k]), int(hubs[k]), *told))
                    told = (None, None)
            if len(out) > 50_000:
                yield batch(fields, list(zip(*out, strict=True)))
                out = []
        if out:
            yield batch(fields, list(zip(*out, strict=True)))

    return map_arrow(full, run, _RESULT)


def match(documents: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, target: float = TARGET) -> tuple[DataFrame, int, float]:
    """Results of ``compare`` over the blocks, the depth at which the walk up the tries ended, and the recall measured there (1 without a pair)."""
    shortest = match_depth(threshold)
    depths = list(range(LONGEST, shortest - 1, -1))
    known = classes.where("rep is not null")
    live = cut(shared_nodes(known, len(depths) - 1).select("rep").distinct())  # what shares no shortest prefix shares no longer one
    known = cut(known.join(live, "rep"))
    payload = cut(texts(documents).where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text").join(live, "rep"))
    results = homes = done = None
    for level, depth in enumerate(depths):
        at = cut(shared_nodes(known, level))
        new = at if homes is None else at.join(homes.select("rep"), "rep", "left_anti")
        new = homes_of(new, level)
        homes = cut(new if homes is None else homes.unionByName(new))
        rows = cut(blocks(at, homes))
        sizes = rows.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1")
        fresh = sizes if done is None else sizes.join(done, ["a", "b", "c"], "left_anti")
        fresh = fresh.select("a", "b")
        compared = cut(compare(rows.join(fresh, ["a", "b"]), known, payload, threshold, width, depths))
        results = compared if results is None else results.join(fresh, ["a", "b"], "left_anti").unionByName(compared)
        done = sizes
        found, stand_for = results.agg(F.sum("found"), F.sum(F.element_at("stand_for", level + 1))).first()
        measured = found / stand_for if found else 1.0
        if found and measured >= target:
            break
        del at, new, rows, sizes, fresh, compared
        let_go(documents.sparkSession)
    return results, depth, measured


def join(documents: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, class_id, n_links, kept: one row for each row of documents.

    class_id is the smallest doc_id reachable by links of similarity ``threshold`` or more, n_links the number of
    other rows linked directly (copies count one by one), kept is true for the row that stands for its class (of
    rows that repeat a doc_id, all with that id). A text without words links with nothing. Rows without doc_id are
    compared only as copies of a text that has one. An empty table gives no rows; further columns are ignored.
    """
    drawn = cut(sketch(documents, threshold, width))
    classes = drawn.where("size > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("weight", F.greatest("size", F.lit(LEAST))).drop("size"))
    compared, _, _ = match(documents, classes, threshold, width)
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    found = connected_components(compared, "rep", "hub")
    by_class = classes.select("f1", "f2", "rep", "n").join(links, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select("f1", "f2", F.coalesce("component", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = drawn.select("doc_id", "f1", "f2").join(by_class, ["f1", "f2"], "left")
    rows = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row of each class, all its columns: that with the smallest doc_id; of rows that repeat doc_id and text, the one whose further columns come first. Rows without doc_id stay, equal texts once."""
    gone = join(documents, threshold, width).where("not kept and doc_id is not null").select("doc_id").distinct()
    left = documents.join(gone, "doc_id", "left_anti").select(documents.columns)
    further = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    copies = left.groupBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min_by(whole, F.to_json(F.struct(*further))).alias("row"))
    return copies.select("row.*")
