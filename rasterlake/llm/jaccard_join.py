"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set and a column for each shingle. Columns are cut into
slices, by hash: a linked pair differs in so few columns, by a bound from its sizes, that it agrees in at least one
whole slice. Rows that agree in a slice are joined into clusters, so that every link lies within a cluster and no
pair outside one is looked at. Each cluster's rows are dealt into blocks, and each pair of blocks is multiplied: the
product accumulates overlap counts over blocks of columns, and pairs that cannot reach the bound any more are
discarded. A pair of blocks returns a forest of its links; the forests' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, NULL_ID, Powers, byte_table, chunks, discard, mix, order_id, word_hashes, words, written
from .components import components, joined

#: Lower bits of a shingle's hash that don't tell whether it is common. Bytes on disk of a slice's key with its node, and what
#: a pass may take of them however small the texts.
PREFIX, KEY_BYTES, LEAST_DISK = np.uint64(16), 20, 1 << 28
#: Rows of a cluster from which on it is cut into smaller ones before pairs of its blocks are multiplied.
LARGE = 1024
KEYS = np.random.default_rng(41).integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct(x: np.ndarray) -> np.ndarray:
    """As np.unique, by a sort: many times faster for hashes than the table that numpy 2.3 makes of them."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Shingler:
    def __init__(self, n: int):
        self.n, self.powers, self.table = n, Powers(42), byte_table(43, lower=True)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Each row's distinct shingles as sorted 64-bit hashes."""
        for x in self.sequences(column):
            yield distinct(x)

    def sequences(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Each row's shingles in order, as 64-bit hashes."""
        n = self.n
        for _, _, data, offsets in chunks(column):
            starts, ends, first = words(data, offsets, SPACED)
            h = word_hashes(data, starts, ends, self.table, self.powers) if len(starts) else np.empty(0, np.uint64)
            m = max(0, len(h) - n + 1)
            g = np.full(m, n, np.uint64)
            for k in range(n):
                g += h[k : k + m] * KEYS[k]
            g = mix(g)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= n:
                    yield g[a : b - n + 1]
                elif b > a:
                    yield mix((h[a:b] * KEYS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
                else:
                    yield g[:0]


def node_of(x: np.ndarray) -> int:
    """A set's id: a hash of its shingles and its size."""
    size = np.full(1, len(x), np.uint64) * KEYS[61]
    return int(mix(mix(x ^ KEYS[60]).sum(dtype=np.uint64, keepdims=True) + size).view(np.int64)[0])


class Slices:
    """How sets are cut, by size. Sizes fall into classes such that linked sets are of the same or neighbouring
    classes; a scheme serves the pairs whose larger set is of its class, and cuts both into one slice more than their
    columns can differ in, and `spare` ones. So a set may leave out up to `spare` slices that are idle: that have no
    columns but common ones. Which slices are idle depends on their columns alone, so two sets that agree in a slice
    both leave it out or neither does. A shingle is common if it has the upper 48 bits of one of `common`. Each `turn`
    deals the columns to slices anew."""

    def __init__(self, percent: int, common: np.ndarray | None = None, turn: int = 0):
        self.percent, self.turn, self.bounds = percent, turn, [1, 2]
        self.common = np.empty(0, np.uint64) if common is None else np.sort(common >> PREFIX)

    def scheme(self, s: int) -> tuple[int, int]:
        """Slices, and spare ones among them."""
        largest, smallest = self.bounds[s + 1] - 1, self.bounds[max(0, s - 1)]
        need = 2 * largest * (100 - self.percent) // (100 + self.percent) + 1
        spare = 1 + need // 8 + int(2 * need * np.exp(-smallest / need)) if need > 1 else 0
        return need + spare, spare

    def class_of(self, size: int) -> int:
        while self.bounds[-1] <= size or len(self.bounds) < 4 or self.bounds[-3] <= size:
            last = self.bounds[-1]
            self.bounds.append(max(last + 1, 100 * (last - 1) // self.percent + 1))
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """Of a sorted set: a hash of each slice's columns, for the schemes of its class and the next."""
        own, out, place = self.class_of(len(x)), [], x
        if self.turn:
            place = mix(x ^ np.uint64(self.turn) * KEYS[58])
            order = np.argsort(place)
            place, x = place[order], x[order]
        unit, value = (place >> np.uint64(11)).astype(np.float64) / (1 << 53), mix(x ^ KEYS[62])
        upper = x >> PREFIX
        at = np.searchsorted(self.common, upper)
        at[at == len(self.common)] = 0
        rare = (self.common[at] != upper).astype(np.int64) if len(self.common) else np.ones(len(x), np.int64)
        for s in (own, own + 1):
            n, spare = self.scheme(s)
            part = (unit * n).astype(np.int64)
            at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            tag = (np.uint64(s) << np.uint64(32)) + part[at].astype(np.uint64)
            made, idle = mix(np.add.reduceat(value, at) + tag * KEYS[63]), np.add.reduceat(rare, at) == 0
            if n - len(at) + int(idle.sum()) <= spare:
                out.append(made[~idle])
            else:
                empty = np.setdiff1d(np.arange(n), part[at]).astype(np.uint64)
                out += [made, mix(((np.uint64(s) << np.uint64(32)) + empty) * KEYS[59])]
        return np.concatenate(out)


def common_shingles(docs: DataFrame, n: int, held: int = 1 << 20, distance: int = 16, least: int = 3, most: int = 1 << 17, varied: bool = False) -> np.ndarray:
    """Shingles of passages that stand in many surroundings, by their upper 48 bits, sorted: those followed, `distance` words
    on, by the most different shingles. Copies of one text don't make their shingles common, nor, if `varied`, do many near
    copies: different ones must follow in most places. Every document counts; the number that is kept is bounded, and any
    choice gives the same links: it only decides which candidates are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, got, size = Shingler(n), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            here, there = (np.concatenate(x) for x in zip(*got))
            got.clear()
            pairs = here >> PREFIX << PREFIX | there & np.uint64(0xFFFF)  # a shingle by 48 bits, what follows by 16
            pairs = np.sort(pairs) if varied else distinct(pairs)
            new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
            pairs = pairs >> PREFIX
            heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            count = np.add.reduceat(new.astype(np.int64), heads)
            many = (count >= least) & (2 * count > np.diff(np.concatenate([heads, [len(pairs)]])))
            if many.any():
                yield pa.record_batch({"shingle": pa.array((pairs[heads][many] << PREFIX).view(np.int64)), "n": pa.array(count[many].astype(np.int64))})

        for batch in batches:
            for ordered in shingler.sequences(batch.column("text")):
                if len(ordered) > distance:
                    got.append((ordered[:-distance], ordered[distance:]))
                    size += len(ordered)
                    if size > held:
                        yield from flush()
                        size = 0
        if got:
            yield from flush()

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(most).collect()
    return np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))


def nodes(docs: DataFrame, n: int, percent: int, hashed: bool = False) -> DataFrame:
    """doc_id (an order id), n_shingles, size class and node of every row; node is null for an empty set. hash, a
    text's, if hashed."""
    more = ["hash"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, slices = Shingler(n), Slices(percent)
        for batch in batches:
            made = [(len(x), slices.class_of(len(x)), node_of(x) if len(x) else None) for x in shingler.sets(batch.column("text"))]
            kinds = (pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)), *(batch.column(c) for c in more)], names=["doc_id", "n_shingles", "class", "node", *more])

    given = docs.select(order_id().alias("doc_id"), "text", *[F.xxhash64("text").alias(c) for c in more])
    return given.mapInArrow(run, "doc_id long, n_shingles long, class int, node long" + "".join(f", {c} long" for c in more))


def candidate_links(docs: DataFrame, n: int, percent: int, held: int = 1 << 20, passes: int = 1, refine: int = 0, **common_of) -> DataFrame:
    """Links a, b that join the sets that agree in a slice. Rows of the input tasks are grouped before the shuffle: sets
    that a task has joined are one link each to the smallest of them, which alone stands for them in the slices' groups.
    The slices are dealt in `passes` passes over the texts, so that only that part of their keys is on disk at a time.
    With `refine` (a turn of Slices) rows have a node and a root, and sets are joined within a root only."""
    common, columns = common_shingles(docs, n, **common_of), ["text", *["node", "root"] * bool(refine)]

    def run(turn: int):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, slices, got, size = Shingler(n), Slices(percent, common, refine), [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                if not got:
                    return
                ids, at = np.unique(np.array([v for _, v in got], np.int64), return_inverse=True)
                keys, own = np.concatenate([k for k, _ in got]), np.repeat(at, [len(k) for k, _ in got])
                got.clear()
                order = np.argsort(keys)
                keys, own = keys[order], own[order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                leader = own[new][np.cumsum(new) - 1]
                rest = ~new & (own != leader)
                root = joined(own[rest], leader[rest], len(ids))
                other = np.flatnonzero(root != np.arange(len(ids)))
                m = int(new.sum())
                # a row with a leader is a link already, any key will do
                yield pa.record_batch({"key": pa.array(np.concatenate([keys[new].view(np.int64), ids[other]])), "node": pa.array(np.concatenate([ids[root[own[new]]], ids[other]])), "leader": pa.array(np.concatenate([np.zeros(m, np.int64), ids[root[other]]]), mask=np.arange(m + len(other)) < m)})

            for batch in batches:
                wanted = zip(*(batch.column(c).to_pylist() for c in columns[1:])) if refine else repeat((None, 0))
                for x, (known, root) in zip(shingler.sets(batch.column("text")), wanted):
                    node = node_of(x) if len(x) else None
                    if len(x) and known in (None, node):  # an id may be on several rows
                        keys = slices.signatures(x)
                        if refine:
                            keys = mix(keys + np.array([root], np.int64).view(np.uint64) * KEYS[57])
                        got.append((keys[keys % np.uint64(passes) == turn] if passes > 1 else keys, node))
                        size += len(got[-1][0])
                        if size > held:
                            yield from flush()
                            size = 0
            yield from flush()

        return made

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            leader = batch.column("leader")
            known = ~np.asarray(leader.is_null())
            links = [np.stack([node[known], leader.fill_null(0).to_numpy()[known]])]
            key, node = key[~known], node[~known]
            if len(key):
                new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
                heads = np.concatenate([[first], node[new]])
                lead = heads[np.cumsum(new)]
                other = lead != node
                links.append(np.stack([node[other], lead[other]]))
                last, first = key[-1], lead[-1]
            pairs = np.concatenate(links, axis=1)
            if pairs.shape[1]:
                ids, at = np.unique(pairs, return_inverse=True)
                root = joined(*at.reshape(pairs.shape), len(ids))
                other = root != np.arange(len(ids))
                yield pa.record_batch({"a": pa.array(ids[other]), "b": pa.array(ids[root[other]])})

    def dealt(turn: int) -> DataFrame:
        rows = docs.select(*columns).mapInArrow(run(turn), "key long, node long, leader long")
        return written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(grouped, "a long, b long"), "candidates")

    return reduce(DataFrame.union, [dealt(turn) for turn in range(passes)])


def linked(ours: list[np.ndarray], theirs: list[np.ndarray], percent: int, same: bool, columns: int = 4096) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) with 100 * |intersection| >= percent * |union|: the product of two blocks of rows of the incidence
    matrix, accumulated over blocks of columns, without the pairs whose rest of columns cannot reach the bound."""
    na, nb = np.array([len(x) for x in ours]), np.array([len(x) for x in theirs])
    # intersection * (100 + percent) >= percent * (na + nb)
    need = -(-percent * (na[:, None] + nb[None, :]) // (100 + percent))
    live = np.minimum(na[:, None], nb[None, :]) >= need
    if same:
        live &= np.tri(len(ours), k=-1, dtype=bool).T
    if not live.any():
        return
    a, b = np.concatenate(ours), np.concatenate(theirs)
    ra, rb = np.repeat(np.arange(len(ours)), na), np.repeat(np.arange(len(theirs)), nb)
    shared = np.intersect1d(distinct(a), distinct(b), assume_unique=True)
    ca, cb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ka, kb = ca < len(shared), cb < len(shared)
    ka[ka], kb[kb] = shared[ca[ka]] == a[ka], shared[cb[kb]] == b[kb]
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    left_a, left_b = np.bincount(ra, minlength=len(ours)), np.bincount(rb, minlength=len(theirs))
    count = np.zeros(need.shape, np.int64)
    for c in range(0, len(shared), columns):
        sa, ea = np.searchsorted(ca, [c, c + columns])
        sb, eb = np.searchsorted(cb, [c, c + columns])
        width = min(columns, len(shared) - c)
        ma, mb = np.zeros((len(ours), width), np.float32), np.zeros((len(theirs), width), np.float32)
        ma[ra[sa:ea], ca[sa:ea] - c] = 1
        mb[rb[sb:eb], cb[sb:eb] - c] = 1
        count += (ma @ mb.T).astype(np.int64)
        left_a -= np.bincount(ra[sa:ea], minlength=len(ours))
        left_b -= np.bincount(rb[sb:eb], minlength=len(theirs))
        live &= count + np.minimum(left_a[:, None], left_b[None, :]) >= need
        if not live.any():
            return
    yield from zip(*(x.tolist() for x in np.nonzero(live & (count >= need))))


def forest(links: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those links that join what the earlier ones have not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            yield a, b


def key_passes(every: DataFrame, percent: int, disk: int) -> int:
    """In how many passes the slices' keys of all nodes keep to `disk` bytes each."""
    slices = Slices(percent)
    slices.class_of(1 << 30)
    sizes = every.where("node IS NOT NULL").groupBy("class").count().collect()  # a row a size class
    return max(1, -(-KEY_BYTES * sum(r["count"] * slices.scheme(s)[0] for r in sizes for s in (r["class"], r["class"] + 1)) // max(1, disk)))


def refined(docs: DataFrame, members: DataFrame, n: int, percent: int, disk: int = 1 << 40, large: int = LARGE, rounds: int = 4) -> DataFrame:
    """members with clusters of more than `large` rows cut into smaller ones, or left as they are if they don't get smaller.

    Passages that a few of a thousand texts share are too rare to count as common among all texts, but the number of sets
    that one of them joins by chance, and the clusters that such chances chain, grow faster than the input; products of
    blocks grow with a cluster's square. Among the texts of large clusters these passages are frequent. So their columns
    are dealt to slices anew, with those that are common here: linked sets agree in a slice of every dealing, so each
    link lies within a new cluster too. Sets that agree with no other one have no links, and go.
    """
    texts = docs.select(order_id().alias("owner"), "text")
    before = None
    for turn in range(1, rounds + 1):
        # a plain table, so that the members of a very large cluster are dealt to several tasks
        sizes = written(members.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > large), "sizes")
        count = sizes.agg(F.sum("size")).first()[0]
        if not count or before and count * 8 > before * 7:
            break
        before = count
        held = written(members.join(sizes, "root").select("owner", "node", "root", "class"), "large")
        rows = written(texts.join(held, "owner").select("text", "node", "root"), "texts")
        parts = components(candidate_links(rows, n, percent, passes=key_passes(held, percent, disk), refine=turn, least=2, varied=turn % 2 == 1))
        rest = members.join(sizes, "root", "left_anti").select("owner", "node", "root", "class")
        members = written(rest.union(held.drop("root").join(parts, "node").select("owner", "node", "root", "class")), "members")
        for old in (sizes, rows, held):
            discard(old)
    return members


def verified_links(docs: DataFrame, members: DataFrame, n: int, percent: int, least_block: int = 256, most_block: int = 1024, disk: int = 1 << 40) -> DataFrame:
    """Links a, b within clusters: rows of blocks of a cluster are multiplied, pair of blocks by pair of blocks.

    members: owner (a row's order id), node, root, class. A block holds rows of one size class of a cluster, an eighth
    of them, but least_block at least and most_block at most; it meets the blocks of its own class and the next ones,
    as other sizes cannot link. A task holds the sets of two blocks. A block's sets are dealt once for each block that it
    meets, so the bytes of that grow with the square of a class; from `disk` bytes on, pairs of blocks are dealt in as many
    passes as keep to it.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, names = Shingler(n), ["root", "node", "class", "below", "own", "above"]
        for batch in batches:
            made = list(shingler.sets(batch.column("text")))
            right = [len(x) > 0 and node_of(x) == v for x, v in zip(made, batch.column("node").to_pylist())]  # an id may be on several rows
            for at in range(0, len(made), 256):
                some = [i for i in range(at, min(at + 256, len(made))) if right[i]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some, pa.int64())) for c in names), pa.array([made[i].tobytes() for i in some], pa.binary())], names=[*names, "columns"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            found = []
            if held and last[1:3] == last[3:5]:
                ids, own = list(held), [x for _, x in held.values()]
                found = [(ids[i], ids[j]) for i, j in forest(linked(own, own, percent, True))]
            elif held:
                a, b = ([(k, x) for k, (at, x) in held.items() if at == side] for side in (last[1:3], last[3:5]))
                if a and b:
                    pairs = linked([x for _, x in a], [x for _, x in b], percent, False)
                    found = list(forest((a[i][0], b[j][0]) for i, j in pairs))
            if found:
                yield pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

        for batch in batches:
            for root, c, i, d, j, k, block, node, columns in zip(*(batch.column(x).to_pylist() for x in ("root", "c", "i", "d", "j", "class", "block", "node", "columns"))):
                if (root, c, i, d, j) != last:
                    yield from flush()
                    last, held = (root, c, i, d, j), {}
                held[node] = ((k, block), np.frombuffer(columns, np.uint64))
        yield from flush()

    counts = members.groupBy("root", "class").agg(F.count("*").alias("size"))
    per_block = F.greatest(F.lit(least_block), F.least(F.lit(most_block), F.ceil(F.col("size") / 8)))
    blocks = counts.select("root", "class", F.ceil(F.col("size") / per_block).cast("int").alias("own"))
    beside = lambda step, name: blocks.select("root", (F.col("class") + step).alias("class"), F.col("own").alias(name))
    blocks = blocks.join(beside(1, "below"), ["root", "class"], "left").join(beside(-1, "above"), ["root", "class"], "left").na.fill(0, ["below", "above"])
    # a plain table, so that the members of a very large cluster are dealt to several tasks
    blocks = written(blocks, "blocks")
    # bytes that the pairs take: a row a class
    dealt = counts.join(blocks, ["root", "class"]).groupBy("class").agg(F.sum(F.col("size") * (F.col("own") + F.col("below") + F.col("above"))).alias("n")).collect()
    bounds = Slices(percent)
    bounds.class_of(1 << 30)
    passes = max(1, -(-sum(8 * r["n"] * bounds.bounds[r["class"] + 1] for r in dealt) // max(1, disk)))
    wanted = members.join(blocks, ["root", "class"])
    texts = docs.select(order_id().alias("owner"), "text")
    rows = texts.join(wanted, "owner").select("text", "root", "node", "class", "below", "own", "above")
    rows = rows.mapInArrow(sets, "root long, node long, class int, below int, own int, above int, columns binary")
    if passes > 1:
        rows = rows_held = written(rows, "sets")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    k, b = F.col("class"), F.col("block")
    each = lambda count, f: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), f)).otherwise(F.array())
    pair = lambda c, i, d, j: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"))
    pairs = F.concat(each("own", lambda o: pair(k, F.least(b, o), k, F.greatest(b, o))), each("above", lambda o: pair(k, b, k + 1, o)), each("below", lambda o: pair(k - 1, o, k, b)))
    key = ["root", "c", "i", "d", "j"]

    def part(turn: int) -> DataFrame:
        # a pass makes rows for its own pairs only
        own = pairs if passes == 1 else F.filter(pairs, lambda x: F.pmod(F.xxhash64(F.lit(7), "root", *[x[c] for c in key[1:]]), F.lit(passes)) == turn)
        mine = rows.withColumn("pair", F.explode(own)).select("root", "pair.*", "class", "block", "node", "columns")
        return mine.repartition(*key).sortWithinPartitions(*key).mapInArrow(products, "a long, b long")

    if passes == 1:
        return part(0)
    links = reduce(DataFrame.union, [written(part(turn), "verified") for turn in range(passes)])
    discard(rows_held)
    return links


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of other characters than [\\x20\\x09-\\x0D], with A-Z as a-z. A row's set are the distinct runs of n
    words, or the whole sequence if it is shorter; a null text or one without words has an empty set and is linked with
    nothing. Rows link when 100 * |intersection| >= percent * |union|; component_id is the smallest doc_id that links
    reach. Rows with equal sets are one node, so repeated rows and copies never make pairs. A null doc_id comes after
    all others and is the component_id only among its like. Sets and shingles are told apart by 64-bit hashes.
    """
    every, found, owners = _linked_nodes(docs, n, percent)
    smallest = found.join(owners, "node").groupBy("root").agg(F.min("owner").alias("component"))
    of_node = found.join(smallest, "root").select("node", "component")
    # a plain table, so that the rows of a set that very many documents share are dealt to several tasks
    labels = written(owners.join(of_node, "node", "left").select("node", F.coalesce("component", "owner").alias("component")), "labels")
    out = every.join(labels, "node", "left")
    known = lambda c: F.when(c != NULL_ID, c)
    return out.select(known(F.col("doc_id")).alias("doc_id"), "n_shingles", known(F.coalesce("component", "doc_id")).alias("component_id"))


def _linked_nodes(docs: DataFrame, n: int, percent: int, hashed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes of docs, the nodes with a link and their component's root, and each node's owner."""
    every = written(nodes(docs, n, percent, hashed), "nodes")
    shingles = every.agg(F.sum("n_shingles")).first()[0] or 0
    owners = every.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("owner"), F.min("class").alias("class"))
    clusters = components(candidate_links(docs, n, percent, passes=key_passes(every, percent, max(LEAST_DISK, 8 * shingles))))
    members = written(clusters.join(owners, "node").select("owner", "node", "root", "class"), "members")
    inside = written(docs.select(order_id().alias("doc_id"), "text").join(members.select(F.col("owner").alias("doc_id")), "doc_id", "left_semi"), "inside")
    members = refined(inside, members, n, percent, max(LEAST_DISK, 8 * shingles), LARGE)
    found = components(verified_links(inside, members, n, percent, disk=4 * shingles))
    discard(inside)
    return every, found, owners


def first_of_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """id (an order id) and hash (xxhash64 of the text) of one row of each component of `jaccard_components`: that with
    the smallest doc_id, and of those the smallest hash. Rows are told apart by both, as ids may be null or shared. A
    row with an empty set is a component of its own; those with equal ids and texts count once."""
    every, found, _ = _linked_nodes(docs, n, percent, hashed=True)
    sets = every.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "hash")).alias("at"))
    part = sets.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("part")).agg(F.min("at").alias("at"))
    alone = every.where("node IS NULL").select("doc_id", "hash").distinct()
    return part.select("at.doc_id", "at.hash").union(alone).withColumnRenamed("doc_id", "id")
