"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set sizes decide.

Every distinct word sequence is one node; copies share it, whatever their ids. A node has a path of MinHash values in each of
``TREES`` prefix tries; a prefix of a path is a trie node, named by a hash. Nodes below one trie node are candidates.

Matching starts at prefixes of ``LONGEST`` values, which only near-identical texts share, and shortens them step by step until the
estimated recall is reached. The estimate comes from the data: of the pairs met so far, how many were met in one tree alone and
how many in two tells how many were met in none (Chao's estimator); pairs below the threshold that meet by chance only lower it.
It never goes below ``depth_for``, the depth at which a pair of just the threshold is met with the wanted recall in any data.

Candidates are grouped by the smallest node of their branch (counted before the shuffle, so a branch with a third of the
rows sends one row per task) and the groups that touch are united. Within a group all pairs are compared exactly, in pairs of
blocks of ``BLOCK`` nodes, by counting common shingles with matrix products: a task holds two blocks at most, returns link
counts and a spanning forest of the links, never the pairs. So no link is lost however large the group. Shingle sets are
computed once per node.

The measure is the Jaccard similarity of the sets of ``NGRAM`` words in a row (a shorter text is one shingle). Texts without
words, null texts and rows without ``doc_id`` stay alone (n_links 0). Every row is judged by its own text, so an id that repeats
with different texts belongs to the class of each. Ties go to the smaller doc_id. Extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, mix, shingles, table, word_hashes, written

NGRAM, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 32, 8, 0.9999
BLOCK = 256
#: Shingles per matrix product: 2 blocks x CHUNK x 4 bytes.
CHUNK = 8192


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which a pair of just ``threshold`` shares a branch with probability ``recall``."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n] | np.uint64(1), base[n:]


def branches(sh: np.ndarray, depths: range, trees: int = TREES) -> list[np.ndarray]:
    """For each of the ascending ``depths`` a 64-bit key per tree: the trie node that the path reaches after as many values."""
    a, b = _seeds(depths[-1] * trees)
    sig = np.full(len(a), np.uint64(2**64 - 1))
    for k in range(0, len(sh), 1024):
        np.minimum(sig, (a[:, None] * sh[None, k : k + 1024] + b[:, None]).min(1), out=sig)
    path = sig.reshape(trees, depths[-1])
    key, out = np.arange(trees, dtype=np.uint64) + np.uint64(1), []
    for k in range(depths[-1]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + path[:, k])
        if k + 1 in depths:
            out.append(key.view(np.int64))
    return out


def sketches(docs: DataFrame, depths: range, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, text_key, seq, keys_<depth>..): per row a hash of the text, the digest of its word sequence, and a trie node per
    tree and depth. Rows without words or id have no digest."""
    names = [f"keys_{d}" for d in depths]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, key, text in zip(pdf["doc_id"], pdf["text_key"], pdf["text"]):
                h = word_hashes(text) if pd.notna(i) else ()
                if len(h):
                    two = [(mix(h + np.uint64(s)) * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64) for s in (1, 2)]
                    out.append((i, key, np.array([*two, np.uint64(len(h))]).tobytes(), *branches(shingles(h, ngram), depths)))
                else:
                    out.append((i, key, None, *[None] * len(names)))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "seq", *names]).astype({"doc_id": "Int64"})

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(sketch, f"doc_id long, text_key long, seq binary, {', '.join(f'{n} array<long>' for n in names)}")


def links_within(sets: list[np.ndarray], blocks: np.ndarray, i: int, j: int, threshold: float) -> np.ndarray:
    """Which pairs of the sets are similar: of block ``i`` with ``j``, or within ``i`` if they are one. Exact."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes.astype(int))
        _, where, df = np.unique(values, return_inverse=True, return_counts=True)
        shared = df > 1
        number = np.cumsum(shared) - 1
        keep = shared[where]
        where, owner = number[where[keep]], owner[keep]
        order = np.argsort(where, kind="stable")
        where, owner = where[order], owner[order]
        common = np.zeros((n, n))
        for start in range(0, int(shared.sum()), CHUNK):
            lo, hi = np.searchsorted(where, [start, start + CHUNK])
            m = np.zeros((n, min(CHUNK, int(shared.sum()) - start)), np.float32)
            m[owner[lo:hi], where[lo:hi] - start] = 1
            common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    similar = common >= threshold * union - 1e-9
    np.fill_diagonal(similar, False)
    if i != j:
        similar &= blocks[:, None] != blocks[None, :]
    return similar


def _forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges (from the first member of each component to each other one)."""
    seen, out = np.zeros(len(similar), bool), []
    for root in range(len(similar)):
        if seen[root] or not similar[root].any():
            continue
        reached = np.zeros(len(similar), bool)
        reached[root], front = True, np.array([root])
        while len(front):
            grown = similar[front].any(0) & ~reached
            reached |= grown
            front = np.flatnonzero(grown)
        seen |= reached
        out += [(root, int(k)) for k in np.flatnonzero(reached) if k != root]
    return out


def forest_edges(nodes: DataFrame, depths: range, recall: float = RECALL, trees: int = TREES) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(edges, steps): candidate edges (a, b) whose components hold all that share a trie node, and the depths tried with the
    recall estimated at each. ``nodes``: (node, keys_<depth>..)."""
    steps: list[tuple[int, float]] = []
    for depth in reversed(depths):
        leaf = nodes.select("node", F.posexplode(f"keys_{depth}").alias("tree", "key"))
        branch = leaf.groupBy("tree", "key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
        shared = written(leaf.join(branch.select("tree", "key", "first"), ["tree", "key"]))
        met = shared.where("node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("trees"))
        pairs, one, two = met.agg(F.count(F.lit(1)), F.count_if(F.col("trees") == 1), F.count_if(F.col("trees") == 2)).first()
        unmet = one * (one + 1) / (2 * (two + 1))  # on the careful side for few pairs
        steps.append((depth, pairs / (pairs + unmet) if pairs else 0.0))
        if steps[-1][1] >= recall:
            break
    # one edge per node, to its smallest branch head; then only the heads that share a branch need edges among themselves
    own = written(shared.groupBy("node").agg(F.min("first").alias("head")))
    headed = shared.join(own, "node").groupBy("tree", "key", "head").agg(F.count(F.lit(1)).alias("n"))
    heads = headed.groupBy("tree", "key").agg(F.min("head").alias("low"), F.max("head").alias("high")).where("low < high")
    between = headed.join(heads, ["tree", "key"]).select(F.col("head").alias("a"), F.col("low").alias("b")).distinct()
    return own.select(F.col("node").alias("a"), F.col("head").alias("b")).union(between).where("a <> b"), steps


def link_table(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, degrees, edges): (doc_id, text_key, node, first_id) of every row, node null without words and first_id the smallest
    doc_id of the node; (node, n_links) of linked nodes; a spanning forest (a, b) of the links."""
    shortest = depth_for(threshold, recall)
    depths = range(shortest, max(LONGEST, shortest) + 1)
    keys = [f"keys_{d}" for d in depths]
    sk = written(sketches(docs, depths, ngram))
    # a node's number is given as its row is written, once and for all
    named = written(sk.where("seq is not null").groupBy("seq").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()))
    first = F.col("doc_id") == F.col("first_id")
    members = written(sk.join(named, "seq", "left").select("doc_id", "text_key", "node", "first_id", *(F.when(first, F.col(k)).alias(k) for k in keys)))
    edges, _ = forest_edges(members.where(F.col(keys[0]).isNotNull()).select("node", *keys), depths, recall)
    group = written(components(edges))
    # a node's set comes from the text of the row that names it
    named_by = members.where(first).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.col("node").alias("node_")).join(group.select(F.col("node").alias("node_")), "node_", "left_semi").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(named_by, (F.col("doc_id") == F.col("id_")) & (F.col("text_key") == F.col("key_")))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "set": [shingles(word_hashes(t), ngram).tobytes() for t in pdf["text"]]})

    sets = written(texts.groupBy(F.col("node_").alias("node")).agg(F.min("text").alias("text")).mapInPandas(sets_of, "node long, set binary"))
    of = written(group.groupBy(F.col("root")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    dealt = group.join(of, "root").select("node", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("with"))
    dealt = dealt.select("node", "root", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy()
        similar = links_within([np.frombuffer(v, np.uint64) for v in pdf["set"]], pdf["block"].to_numpy(), key[1], key[2], threshold)
        degree = similar.sum(1)
        forest = np.array(_forest(similar), int).reshape(-1, 2)
        counted = pd.DataFrame({"node": node, "to": None, "n": degree})[degree > 0]
        return pd.concat([counted, pd.DataFrame({"node": node[forest[:, 0]], "to": node[forest[:, 1]], "n": 0})]).astype({"to": "Int64"})

    found = written(dealt.join(sets, "node").groupBy("root", "i", "j").applyInPandas(compare, "node long, to long, n long"))
    degrees = found.where("to is null").groupBy("node").agg(F.sum("n").alias("n_links"))
    return members.select("doc_id", "text_key", "node", "first_id"), degrees, found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))


def classes(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (``xxhash64`` of the text), class_id, copy_of, n_links; see ``similar_documents``."""
    members, degrees, edges = link_table(docs, ngram, threshold, recall)
    named = members.where("node is not null").select("node", "first_id").distinct()
    roots = components(edges)
    smallest = roots.join(named, "node").groupBy("root").agg(F.min("first_id").alias("class"))
    info = roots.join(smallest, "root").join(degrees, "node").select(F.col("node").alias("node_"), "class", "n_links")
    out = members.join(info, F.col("node") == F.col("node_"), "left")
    return out.select("doc_id", "text_key", F.coalesce("class", "first_id", "doc_id").alias("class_id"), F.coalesce("first_id", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar_documents(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: doc_id; class_id, the smallest doc_id that its text reaches through links; copy_of, the smallest doc_id
    with the same words; n_links, the number of other texts (not copies) with at least ``threshold``."""
    return classes(docs, ngram, threshold, recall).drop("text_key")


def keep_one(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id names the class of their text, columns unchanged; rows without id or words stay."""
    gone = classes(docs, ngram, threshold).where("class_id <> doc_id").select(F.col("doc_id").alias("gone_id_"), F.col("text_key").alias("gone_key_")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id_"]) & (F.xxhash64(docs["text"]) == gone["gone_key_"]), "left_anti")


def op3(spark, sf_dir: str) -> DataFrame:
    """Per document: its class, the text it copies and its number of links."""
    return similar_documents(table(spark, sf_dir, "documents"))
