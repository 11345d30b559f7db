"""Exact n-gram Jaccard join with a token-group matrix.

A document's set holds its distinct k-word shingles.  Documents with equal sets
are one node.  The join keeps, for every node, the prefix of its tokens in one
global order (rare tokens first): nodes that link share a prefix token.

1. Prefixes are long enough for linked nodes to share ``SHARED`` of their tokens
   (or all they share).  Postings that hold one node only are dropped, and so are
   nodes left with fewer tokens than a link needs.
2. In each posting every node is held against one pivot, the node with the fewest
   rarer tokens.  Pairs that share enough prefix tokens are compared exactly, and
   the links found partition similar nodes into groups (connected components).
3. The token-group matrix holds the distinct (prefix token, group) pairs left.
   A node queries another group if it shares enough tokens with the union of the
   group's prefixes, the first of them at a place that leaves enough tokens to
   link; only such groups are opened, in blocks of at most about ``BLOCK`` members with the
   union of all their tokens.  The node's overlap with that union bounds the one with any
   member, and only if the bound allows a link are the members compared exactly.

No pairs within a group are listed, and no link between nodes is lost: each pair
of linked nodes that step 2 left in different groups is met in step 3.  The
order of tokens (common ones, counted where they repeat in a batch, last) bounds postings
and never changes results.

Defined results: null, empty or blank texts have no shingle and link with
nothing; a text of fewer than k words has one; equal rows link; words are runs
of non-space with A-Z lowered; an empty table gives an empty result; extra
columns are ignored, whatever their names.  A null doc_id is never the least of its
component.  Very long texts are taken whole; a task holds one Arrow batch of texts and
the token sets of one block of members.  Ties (equal least doc_ids) are broken by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import Words, chunks, mix
from .store import deflate, inflate, lean, unused

#: Members of a group that are opened together.
BLOCK = 256
#: Length of the list of common tokens that come last in the order (1.6 MB), and the count that makes one common.
COMMON, COMMON_AT = 100_000, 8
#: Prefixes are long enough for linked sets to share this many of their tokens, or all that they share.
SHARED = 3
#: The postings of a common token are dealt over this many tasks, by node.
PARTS = 64
#: Bits of the filter that says which nodes' texts are wanted (4 MB).
FILTER_BITS = 1 << 25


def token_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(row, sorted distinct tokens, text) for every text."""
    for a, b, data, offsets in chunks(column, 1 << 18):
        words = Words(data, offsets, lower=True)
        grams, n = words.shingles(k), np.diff(words.first)
        short = {m: words.shingles(m) for m in set(n[(n > 0) & (n < k)].tolist())}
        for i in range(b - a):
            lo, m = int(words.first[i]), int(n[i])
            if m >= k:
                tokens = np.unique(grams[lo : lo + m - k + 1])
            elif m:
                tokens = mix(short[m][lo : lo + 1] ^ np.uint64(m))
            else:
                tokens = np.empty(0, dtype=np.uint64)
            yield a + i, tokens, data[offsets[i] : offsets[i + 1]]


def signature(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a token set."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def _common(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, parts = set(), []
        for _, tokens, _ in token_sets(batch.column(0), k):
            if len(tokens) and (s := signature(tokens)) not in seen:
                seen.add(s)
                parts.append(tokens)
        token, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
        many = count > 1
        yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many])], names=["token", "n"])


def common_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Tokens that repeat within Arrow batches, the most common last; at most COMMON of them."""
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(lambda it: _common(it, k)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= COMMON_AT).orderBy(F.desc("n"), "token").limit(COMMON).collect()
    return np.array([r[0] for r in reversed(top)], dtype=np.int64).view(np.uint64)


def _prefixes(batches: Iterable[pa.RecordBatch], k: int, percent: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, part, node, n, rest) for the prefix of every distinct set of a batch; rest: how many of its tokens come later, part: see PARTS."""
    order = np.argsort(common)
    known, rank = common[order], order
    for batch in batches:
        seen: set[int] = set()
        tokens_, parts, nodes, sizes, counts = [], [], [], [], []

        def out() -> pa.RecordBatch:
            times = np.array(counts, dtype=np.int64)
            flat = np.concatenate(tokens_) if tokens_ else np.empty(0, dtype=np.uint64)
            part = np.concatenate(parts) if parts else np.empty(0, dtype=np.int16)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times)
            rest = np.repeat(np.array(sizes, dtype=np.int64), times) - place - 1
            columns = [flat.view(np.int64), part, np.repeat(np.array(nodes, dtype=np.int64), times), np.repeat(np.array(sizes, dtype=np.int32), times), rest.astype(np.int32)]
            for x in (tokens_, parts, nodes, sizes, counts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "part", "node", "n", "rest"])

        for _, tokens, _ in token_sets(batch.column(0), k):
            if not len(tokens) or (node := signature(tokens)) in seen:
                continue
            seen.add(node)
            n = len(tokens)
            take = min(n, n - needed(n, percent) + SHARED)
            own = np.zeros(n, dtype=np.int16)
            if len(known):
                at = np.searchsorted(known, tokens)
                at[at == len(known)] = 0
                late = known[at] == tokens
                if late.any():
                    tokens = np.concatenate([tokens[~late], tokens[late][np.argsort(rank[at[late]])]])
                    own[n - int(late.sum()) :] = 1 + node % PARTS
            tokens_.append(tokens[:take])
            parts.append(own[:take])
            nodes.append(node)
            sizes.append(n)
            counts.append(take)
            if len(counts) >= 1000:
                yield out()
        yield out()


def _live(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, part and node, those whose token has two nodes or more or is a common one, each node once; state is one row."""
    last: np.ndarray | None = None
    given = False
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
        if not len(rows):
            continue
        if last is not None:
            rows = np.concatenate([last, rows])
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        rows = rows[fresh]
        same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        keep = rows[:, 1] > 0
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and given:
            # the first row went out with the batch before; it still vouches for its successors
            keep[0] = False
        if len(rows) > 1:
            given = bool(keep[-1])
        else:
            given = given or bool(keep[-1])
        last = rows[-1:].copy()
        yield _columns(rows[keep])


def _columns(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 2]), pa.array(rows[:, 3].astype(np.int32)), pa.array(rows[:, 4].astype(np.int32))], names=["token", "node", "n", "rest"])


def bit_places(node: int) -> tuple[int, ...]:
    """Bits of a node, itself a hash, in the filter of wanted nodes."""
    return tuple((node >> s) & (FILTER_BITS - 1) for s in (0, 19, 38))


def wanted_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over nodes; a fuller one lets more others pass, and never drops a node."""
    places = F.explode(F.array(*(F.shiftright("node", s).bitwiseAND(F.lit(FILTER_BITS - 1)) for s in (0, 19, 38)))).alias("at")
    words = nodes.select(places).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[[r[0] for r in words]] = [r[1] for r in words]
    return out.view(np.uint64)


def _texts(batches: Iterable[pa.RecordBatch], k: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {}
        for _, tokens, text in token_sets(batch.column(0), k):
            if len(tokens) and (node := signature(tokens)) not in seen and all(int(wanted[b >> 6]) >> (b & 63) & 1 for b in bit_places(node)):
                seen[node] = deflate(text.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.int64()), pa.array(list(seen.values()), type=pa.binary())], names=["node", "packed"])


class Block:
    """Members of a group with the union of their tokens, indexed by token."""

    def __init__(self, members: dict[int, np.ndarray]):
        self.nodes, sets = list(members), list(members.values())
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))

    def link(self, tokens: np.ndarray, percent: int) -> int | None:
        """A member that links with tokens; members are looked at only if the overlap with the union allows a link."""
        if not len(self.nodes):
            return None
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == tokens]
        if len(at) < max(needed(len(tokens), percent), needed(int(self.sizes.min()), percent)):
            return None
        times = self.first[at + 1] - self.first[at]
        owners = self.owner[np.repeat(self.first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        shared = np.bincount(owners, minlength=len(self.nodes))
        linked = np.flatnonzero(100 * shared >= percent * (len(tokens) + self.sizes - shared))
        return self.nodes[linked[0]] if len(linked) else None


def _verify(batches: Iterable[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of queries to members, over rows (grp, block, query, node, packed) sorted so that members come first."""
    now, members, opened, done = None, {}, None, set()
    for batch in batches:
        links: list[tuple[int, int]] = []
        packed = batch.column(4)
        for i, (grp, block, query, node) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)))):
            if (grp, block) != now:
                now, members, opened, done = (grp, block), {}, None, set()
            if node in members or node in done:
                continue
            tokens = next(token_sets(pa.array([inflate(packed[i].as_py())], type=pa.binary()).cast(pa.string()), k))[1]
            if not query:
                members[node] = tokens
                continue
            done.add(node)
            opened = opened or Block(members)
            if (other := opened.link(tokens, percent)) is not None:
                links.append((node, other))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], type=pa.int64()), pa.array([x[1] for x in links], type=pa.int64())], names=["a", "b"])


def _node_texts(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, packed) with one text of each of the nodes, and of a few others that the filter lets pass."""
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_filter(nodes))
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(lambda it: _texts(it, k, wanted.value)), "node long, packed binary")
    return found.groupBy("node").agg(F.first("packed").alias("packed")).checkpoint()


def _open(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Exact links of queries to members, for rows (grp, block, query, node)."""
    joined = rows.join(texts, "node").select("grp", "block", "query", "node", "packed")
    return joined.repartition("grp", "block").sortWithinPartitions("grp", "block", "query").mapInArrow(lean(lambda it: _verify(it, k, percent)), "a long, b long").checkpoint()


def _stars(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Exact links among distinct pairs (node, grp) of a node and a pivot; a pivot with many followers is compared in several tasks."""
    pairs = pairs.checkpoint()
    spread = _blocks(pairs.groupBy("grp").agg(F.count("*").alias("size")))
    queries = pairs.join(spread, "grp").select("grp", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("query"), "node")
    pivots = spread.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("query"), F.col("grp").alias("node"))
    return _open(queries.unionByName(pivots), texts, k, percent)


def _blocks(sizes: DataFrame) -> DataFrame:
    """grp, blocks: the number of blocks of at most about BLOCK members."""
    return sizes.select("grp", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))


def links(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Enough exact links (a, b) between nodes to connect every component."""
    common = common_tokens(docs, k)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    prefixes = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(lambda it: _prefixes(it, k, percent, shared.value)), "token long, part short, node long, n int, rest int")
    met = prefixes.repartition("token", "part").sortWithinPartitions("token", "part", "node").mapInArrow(lean(_live), "token long, node long, n int, rest int").checkpoint()

    def least_shared(n: Column) -> Column:
        """Prefix tokens that a set of n shares with any set it links to."""
        return F.least(F.lit(SHARED), F.ceil(n * percent / 100))

    several = met.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= least_shared(F.col("n"))).select("node")
    live = met.join(several, "node").select("token", "node", "n", "rest").checkpoint()

    def sizes_agree(n: Column, lo: Column, hi: Column) -> Column:
        return (hi * 100 >= n * percent) & (lo * percent <= n * 100)

    def places_agree(bound: Column, n: Column, least: Column) -> Column:
        """No more are shared than the first shared token and the shorter of the rests after it."""
        return bound * (100 + percent) >= (n + least) * percent

    texts = _node_texts(several, docs, k)
    # a token's pivot is the node with the fewest rarer tokens, which is nearest to what the others have in common
    pivots = live.groupBy("token").agg(F.min_by(F.struct("node", "n", "rest"), F.struct(F.col("n") - F.col("rest"), "node")).alias("p"))
    stars = live.join(pivots, "token").where((F.col("node") != F.col("p.node")) & sizes_agree(F.col("n"), F.col("p.n"), F.col("p.n")))
    stars = stars.groupBy("node", F.col("p.node").alias("pivot")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("p.n").alias("m"), (F.max(F.least("rest", "p.rest")) + 1).alias("bound"))
    stars = stars.where((F.col("c") >= least_shared(F.col("n"))) & places_agree(F.col("bound"), F.col("n"), F.col("m")))
    first = _stars(stars.select("node", F.col("pivot").alias("grp")), texts, k, percent)
    groups = components(first).checkpoint()

    known = live.join(groups, "node", "left").select("token", "node", "n", "rest", F.coalesce("comp", "node").alias("grp"))
    matrix = known.groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("most"))
    crossed = matrix.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    matrix = matrix.join(crossed, "token").select("token", F.col("grp").alias("target"), "lo", "hi", "most")
    # what holds for a group's least size and longest rest holds for every member; tokens shared with its union bound those shared with a member
    # and the first SHARED tokens that a linked pair shares lie where enough come after them
    near = places_agree(F.least("rest", "most") + SHARED, F.col("n"), F.col("lo"))
    asks = known.join(matrix, "token").where((F.col("target") < F.col("grp")) & sizes_agree(F.col("n"), F.col("lo"), F.col("hi")) & near)
    asks = asks.groupBy("node", F.col("target").alias("grp")).agg(F.count("*").alias("c"), F.first("n").alias("n"), (F.max(F.least("rest", "most")) + 1).alias("bound"), F.min("lo").alias("lo"))
    asks = asks.where((F.col("c") >= least_shared(F.col("n"))) & places_agree(F.col("bound"), F.col("n"), F.col("lo"))).select("node", "grp").checkpoint()
    sizes = groups.groupBy(F.col("comp").alias("grp")).agg(F.count("*").alias("size"))
    blocks = asks.select("grp").distinct().join(_blocks(sizes), "grp", "left").select("grp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    in_block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    members = blocks.join(groups.select(F.col("comp").alias("grp"), "node"), "grp", "left").select("grp", F.coalesce("node", "grp").alias("node"), "blocks").select("grp", in_block, F.lit(0).alias("query"), "node")
    queries = asks.join(blocks, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"), "node")
    return first.unionByName(_open(members.unionByName(queries), texts, k, percent))


def _sizes(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, node = [], []
        for _, tokens, _ in token_sets(batch.column(2), k):
            n.append(len(tokens))
            node.append(signature(tokens) if len(tokens) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, type=pa.int64()), pa.array(node, type=pa.int64())], names=["doc_id", "row", "n_shingles", "node"])


def join_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, row (a hash of doc_id and text), n_shingles, component_id, first (row of the group's first document)."""
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(lambda it: _sizes(it, k)), "doc_id long, row long, n_shingles long, node long").checkpoint()
    named = sets.join(components(links(docs, k, percent)), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("m"))
    out = named.join(least, "comp", "left")
    return out.select("doc_id", "row", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("m.doc_id")).alias("component_id"), F.coalesce("m.row", "row").alias("first"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The first document (least doc_id) of every component, once, with its columns; documents without words all stay.

    Only rows that have equals (in doc_id and text) go through a shuffle for being single.
    """
    row = unused(docs, "row")
    chosen = join_groups(docs, k, percent).where("n_shingles = 0 OR row = first")
    kept = chosen.groupBy(F.col("row").alias(row)).agg((F.max("n_shingles") == 0).alias("all"), F.count("*").alias("copies")).checkpoint()
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    plain = keyed.join(kept.where("all OR copies = 1").select(row), row, "left_semi")
    again = keyed.join(kept.where("NOT all AND copies > 1").select(row), row, "left_semi").dropDuplicates([row])
    return plain.unionByName(again).select(*docs.columns)
