"""Exact Jaccard join of word shingle sets with a prefix tree.

1. Equal sets are one node, the smallest doc_id of those that have it.
2. Shingles have one order everywhere, frequent ones last for prefixes, first in the
   tree. A set that links to another shares at least l shingles with it among the first
   |x| - ceil(t |x|) + l of both. With l about half of |x| - ceil(t |x|) + 1, sets of whose
   prefix fewer stand in any other prefix are done.
3. A set is stored once, with its home: the shingle of its prefix that most prefixes have.
   It asks at the homes of all sets that share a prefix shingle with it, if the sets there
   have at least l of its shingles together. Who links, meets there.
4. Homes beyond a fair share of all rows are dealt into chunks, stored by asking, each pair of
   them one piece of work; small homes are put together.
5. A task stores a home's sets in a prefix tree and walks it, level by level, with all
   sets that ask: sets with equal beginnings share the overlap counted so far,
   and a subtree whose remaining lengths can't reach the threshold is left out.
6. A task sends, besides counts, one edge for each node of its stars, not its pairs. These
   go to connected components; copies get their node's result.

Nothing is capped: the order of shingles only changes the work, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ids_fit, table, unused, written
from .components import components
from .hashing import Rolled, U, word_hashes
from .tokenizing import slices

WORDS = 4
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Counted shingles that tasks keep in memory for the order; the most frequent ones.
MOST_FREQUENT = 300_000
#: Shingles of a chunk, and the fewest sets that are worth parting.
CHUNK, FEWEST = 1_000_000, 100
#: Shingles of the pieces of work that are put together in a task.
TASK = 4_000_000
#: Shingles of one edge of the tree; bytes that a step of the walk takes.
EDGE, STEP = 32, 32_000_000
#: Ids up to which a table is broadcast, 16 bytes each.
MOST_BROADCAST = 500_000


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; fewer words make one shingle."""
    docs = [t.encode().lower().split() for t in texts]
    h, ends = word_hashes(docs)
    rolled = Rolled(h)
    spans = rolled.windows(words)
    out, start = [], 0
    for e in ends.tolist():
        if e - start >= words:
            out.append(np.unique(spans[start : e - words + 1]))
        else:
            out.append(rolled.spans(np.array([start]), np.array([e])) if e > start else np.zeros(0, U))
        start = e
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _parts(texts: pa.Array, most: int = 2_000_000):
    """First place, end and texts of parts of about `most` code points: only one part's texts are Python objects at a time."""
    for i, j in slices(texts, pc.utf8_length(texts).to_pylist(), most):
        yield i, j, texts.slice(i, j - i).to_pylist()


def thrice(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand in s three times or more, and how often; s is sorted in place, as np.unique would hold several more of its size."""
    s.sort()
    first = s[2:] == s[:-2]
    first[1:] &= s[1:-2] != s[:-3]
    u = s[: len(first)][first]
    return u, np.searchsorted(s, u, "right") - np.flatnonzero(first)


def met_often(batches, words: int = WORDS, most: int = 4_000_000):
    """h, n of the shingles that stand in three documents or more of a run of texts with some more than `most` shingles, run by run."""
    held, size = np.empty(most + most // 4, U), 0  # memory is taken as it fills

    def heavy():
        u, n = thrice(held[:size])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    for b in batches:
        for _, _, texts in _parts(b.column(1)):
            got = shingle_sets(texts, words)
            end = size + sum(map(len, got))
            if end > len(held):
                held = np.concatenate([held[:size], np.empty(end - size, U)])
            if got:
                np.concatenate(got, out=held[size:end])
            size = end
            if size > most:
                yield heavy()
                size = 0
    if size:
        yield heavy()


def frequent(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a task met in three documents or more, with these counts summed over all tasks."""

    def run(batches):
        return met_often(batches, words)

    top = _texts(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    rows = top.toArrow()
    h, n = rows["h"].to_numpy().view(U), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(n, percent: int = PERCENT):
    """Length of the prefix of a set of n shingles, and how many of them any set that it links to shares at least."""
    spare = lambda k: k - -(-percent * k // 100)
    some = lambda k: max(1, (spare(k) + 1) // 2)
    if 100 * n < percent * (n + 1):  # only an equal set is near enough
        return 0, 0
    return spare(n) + some(n), some(-(-percent * n // 100))


def uses(shingles: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each shingle stands in the corpus, 0 for those that aren't frequent."""
    h, n = known
    if not len(h):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(h, shingles), len(h) - 1)
    return np.where(h[at] == shingles, n[at], 0)


def in_order(s: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's shingles, those that aren't frequent first, by hash."""
    return s[np.lexsort((s, uses(s, known)))]


def least_overlap(a, b, percent: int = PERCENT):
    """Shared shingles that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """A prefix tree of ordered sets: an edge holds several shingles, sets with equal beginnings share its nodes.

    Edges from the root hold as many as a set may lack in one that it links with, and one more; others EDGE. So what links with a
    set has a shingle of the first edge on its way. A level has, for each node, its edge's tokens (the number after the last one stands for
    none), its parent's place, the sizes of the smallest and longest set below, and the places and nodes of the sets that end there.
    """

    def __init__(self, sets: list[np.ndarray], known: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0, np.int64)), percent: int = PERCENT):
        self.sizes = np.array([len(x) for x in sets])
        cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
        none = len(self.tokens)
        rank = np.empty(none, np.int64)
        rank[np.lexsort((self.tokens, -uses(self.tokens, known)))] = np.arange(none)
        self.at_rank = rank
        which = np.repeat(np.arange(len(sets)), self.sizes)
        flat = rank[where][np.lexsort((rank[where], which))]
        self.levels = []
        node = np.zeros(len(sets), np.int64)  # of each set, in the level before
        begin, width = 0, max(EDGE, int((self.sizes - -(-percent * self.sizes // 100)).max()) + 1)
        while (own := np.flatnonzero(self.sizes > begin)).size:
            at = cuts[own][:, None] + begin + np.arange(width)
            inside = begin + np.arange(width) < self.sizes[own][:, None]
            block = np.where(inside, flat[np.minimum(at, len(flat) - 1)], none)
            rows, place = np.unique(np.column_stack([node[own], block]), axis=0, return_inverse=True)
            place = place.reshape(-1)
            small, long_ = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
            np.minimum.at(small, place, self.sizes[own])
            np.maximum.at(long_, place, self.sizes[own])
            begin += width
            ends = self.sizes[own] <= begin
            self.levels.append((begin, rows[:, 0], rows[:, 1:], small, long_, own[ends], place[ends]))
            node[own] = place
            width = EDGE
        # the nodes below the root by token
        first = self.levels[0][2]
        nodes, slots = np.nonzero(first != none)
        order = np.argsort(first[nodes, slots], kind="stable")
        self.posted, self.posts = first[nodes, slots][order], nodes[order]

    def linked(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Places of the stored sets that link with one set."""
        return self.links([own], percent)[1]

    def links(self, asking: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of asking and of stored sets that link, pair by pair."""
        each = max(1, STEP // (len(self.tokens) + 1))
        found = [self._walked(asking[k : k + each], percent, k) for k in range(0, len(asking), each)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walked(self, asking: list[np.ndarray], percent: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        mark = np.zeros((len(asking), len(self.tokens) + 1), np.uint8)
        below = len(self.levels[0][1])
        pairs = []
        for k, own in enumerate(asking):
            at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
            ranks = self.at_rank[at[self.tokens[at] == own]]
            mark[k, ranks] = 1
            pairs.append(k * below + self.posts[_ranged(np.searchsorted(self.posted, ranks), np.searchsorted(self.posted, ranks, "right"))])
        met, shared = np.unique(np.concatenate(pairs), return_counts=True)
        q, node = met // below, met % below
        sizes = np.array([len(x) for x in asking])
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for k, (end, parent, block, small, long_, ended, of) in enumerate(self.levels):
            if k:
                # each pair goes on to the node's children; nodes lie in the order of their parents
                low, high = np.searchsorted(parent, node), np.searchsorted(parent, node, "right")
                up, node = np.repeat(np.arange(len(node)), high - low), _ranged(low, high)
                q, shared = q[up], shared[up]
                shared += _held(mark, q, node, block)
            n, low, high = sizes[q], small[node], long_[node]
            most = shared + np.minimum(n - shared, np.maximum(high - end, 0))
            ok = (most >= least_overlap(n, low, percent)) & (100 * high >= percent * n) & (100 * n >= percent * low)
            q, node, shared = q[ok], node[ok], shared[ok]
            if not len(q):
                break
            if len(ended):
                by = np.argsort(of, kind="stable")
                low, high = np.searchsorted(of[by], node), np.searchsorted(of[by], node, "right")
                up, sets = np.repeat(np.arange(len(node)), high - low), ended[by][_ranged(low, high)]
                good = 100 * shared[up] >= percent * (sizes[q[up]] + self.sizes[sets] - shared[up])
                out[0].append(q[up][good] + first)
                out[1].append(sets[good])
        return np.concatenate(out[0]), np.concatenate(out[1])


def _held(mark: np.ndarray, q: np.ndarray, node: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each pair of an asking set and a node the edge's tokens that the set has; q is in order."""
    out = np.zeros(len(q), np.int64)
    if not len(q):
        return out
    asks, nodes = np.unique(q), np.unique(node)
    if 4 * len(q) < len(asks) * len(nodes):
        for i in range(0, len(q), STEP // EDGE):
            out[i : i + STEP // EDGE] = mark[q[i : i + STEP // EDGE, None], block[node[i : i + STEP // EDGE]]].sum(1)
        return out
    # most pairs are there: whole rows at once
    at, tokens = np.searchsorted(nodes, node), block[nodes].ravel()
    each = max(1, STEP // len(tokens))
    for i in range(0, len(asks), each):
        some = asks[i : i + each]
        low, high = np.searchsorted(q, [some[0], some[-1] + 1])
        rows = mark[some[0] : some[-1] + 1] if some[-1] - some[0] + 1 == len(some) else mark[some]
        held = np.take(rows, tokens, axis=1).reshape(len(some), len(nodes), -1).sum(2, dtype=np.uint8)
        out[low:high] = held[np.searchsorted(some, q[low:high]), at[low:high]]
    return out


def _ranged(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each of low to below its high, one range after another."""
    n = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(int(n.sum()))


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node of its component under the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def joined(rows: pa.Table, known: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> pa.Table:
    """Links of one task: a, b of stars that connect what links, and for each node that asks (as a = b) its number of linked copies."""
    piece = np.column_stack([rows[c].to_numpy() for c in ("home", "i", "j")])
    ids, copies, side = rows["low"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
    blobs = rows["shingles"].combine_chunks() if rows["shingles"].num_chunks != 1 else rows["shingles"].chunk(0)
    order = np.lexsort((ids, piece[:, 2], piece[:, 1], piece[:, 0]))
    order = order[np.append(True, (piece[order[1:]] != piece[order[:-1]]).any(1) | (ids[order[1:]] != ids[order[:-1]]))]  # repeated rows of a document have one set
    begins = np.flatnonzero(np.append(True, (piece[order[1:]] != piece[order[:-1]]).any(1)))
    out: list[list[np.ndarray]] = [[], [], []]
    for own in np.split(order, begins[1:]):
        stored, asks = own[side[own] != 1], own[side[own] != 0]
        if not len(stored) or not len(asks) or (len(own) == 1):
            continue
        sets = {x: np.frombuffer(blobs[x].as_buffer(), U) for x in own.tolist()}
        q, x = Trie([sets[k] for k in stored.tolist()], known, percent).links([sets[k] for k in asks.tolist()], percent)
        q, x = asks[q], stored[x]
        q, x = q[ids[q] != ids[x]], x[ids[q] != ids[x]]
        n = np.bincount(q, copies[x], len(ids)).astype(np.int64)
        some = np.flatnonzero(n)
        for c, v in zip(out, (ids[some], ids[some], n[some])):
            c.append(v)
        nodes, at = np.unique(np.concatenate([q, x]), return_inverse=True)
        root = stars(at[: len(q)], at[len(q) :], len(nodes))
        for c, v in zip(out, (ids[nodes], ids[nodes[root]], np.zeros(len(nodes), np.int64))):
            c.append(v[root != np.arange(len(nodes))])
    none = np.zeros(0, np.int64)
    return pa.table(dict(zip("abn", (pa.array(np.concatenate([none, *c]), pa.int64()) for c in out))))


def _met(tokens: DataFrame) -> DataFrame:
    """Of low, need, token those whose token another set has, then those sets that still have as many as they need."""
    shared = tokens.groupBy("token").agg(F.min("low").alias("lo"), F.max("low").alias("hi")).filter("lo < hi").select("token")
    tokens = tokens.join(shared, "token", "left_semi").select("low", "need", "token")
    return tokens


def _enough(tokens: DataFrame) -> DataFrame:
    enough = tokens.groupBy("low", "need").agg(F.countDistinct("token").alias("n")).filter("n >= need").select("low")
    return tokens.join(enough, "low", "left_semi").select("low", "need", "token")


def meetings(tokens: DataFrame) -> DataFrame:
    """low, home, own: where each set asks, and whether it is stored there. tokens: low, need, token, distinct."""
    uses_ = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    home = tokens.join(uses_, "token").groupBy("low").agg(F.max(F.struct("uses", "token"))["token"].alias("home"))
    home = written(home, "jaccard-homes")
    where = tokens.join(home, "low").select("token", "home").distinct()
    # the most used of a set's shingles is its home: a shingle that many sets have leads to few homes
    asks = tokens.join(where, "token").groupBy("low", "need", "home").agg(F.count(F.lit(1)).alias("n")).filter("n >= need").select("low", "home")
    own = home.select("low", F.col("home").alias("at"))
    return asks.join(own, "low").select("low", "home", (F.col("home") == F.col("at")).alias("own"))


def dealt(asks: DataFrame, sizes: DataFrame, chunk: int = CHUNK, fewest: int = FEWEST) -> DataFrame:
    """low, places: the pieces of work (task, home, i, j) that a set belongs to, and its side there: 0 stored, 1 asking, 2 both.

    asks: low, home, own; sizes: low, n. A home is parted where it has more than a
    partition's fair share of all rows, or more shingles than a chunk.
    """
    spark = asks.sparkSession
    asks = written(asks.join(sizes, "low"), "jaccard-asks")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = asks.count()
    fair = max(fewest, total // partitions)
    load = asks.groupBy("home").agg(F.count(F.lit(1)).alias("q"), F.sum("n").alias("qn"), F.count_if("own").alias("s"), F.sum(F.when(F.col("own"), F.col("n"))).alias("sn")).filter("q > 1")
    load = load.select("home", F.ceil(F.greatest(F.col("q") / fair, F.col("qn") / chunk)).cast("int").alias("kq"), F.ceil(F.greatest(F.col("s") / fair, F.col("sn") / chunk)).cast("int").alias("ks"))
    rows = asks.join(load, "home").select("low", "home", "own", "n", "kq", "ks", F.pmod(F.xxhash64("low"), F.col("kq")).cast("int").alias("j"), F.pmod(F.xxhash64("low", F.lit(1)), F.col("ks")).cast("int").alias("i"))
    asking = F.transform(F.sequence(F.lit(0), F.col("ks") - 1), lambda k: F.struct(k.alias("i"), F.col("j").alias("j"), F.when(F.col("own") & (k == F.col("i")), 2).otherwise(1).alias("side")))
    stored = F.transform(F.filter(F.sequence(F.lit(0), F.col("kq") - 1), lambda k: F.col("own") & (k != F.col("j"))), lambda k: F.struct(F.col("i").alias("i"), k.alias("j"), F.lit(0).alias("side")))
    rows = rows.select("low", "home", "n", F.explode(F.concat(asking, stored)).alias("p")).select("low", "home", "n", "p.*")
    rows = written(rows, "jaccard-places")
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    bins = max(4 * partitions, -(-size // TASK))
    task = F.pmod(F.xxhash64("home", "i", "j"), F.lit(bins))
    return rows.groupBy("low").agg(F.collect_list(F.struct(task.alias("task"), "home", "i", "j", "side")).alias("places"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK, fewest: int = FEWEST) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked with it) of each row.

    Texts without words, null ones too, have no shingles and no links. Rows of
    one id are one document: what links to one of their texts links to all. Rows
    with a null id are not linked and have a null component.
    """
    known = frequent(docs, words, percent)

    def prefixes(batches):
        for b in batches:
            for i, j, texts in _parts(b.column(1)):
                sets = shingle_sets(texts, words)
                marks = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                n = [len(s) for s in sets]
                sizes = [prefix(m, percent) for m in n]
                first = [in_order(s, known)[:k].view(np.int64) if k else s[:0].view(np.int64) for s, (k, _) in zip(sets, sizes)]
                cuts = np.concatenate([[0], np.cumsum([len(f) for f in first])])
                flat = np.concatenate(first) if first else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array([(m >> 64) - (1 << 63) for m in marks], pa.int64()),
                        pa.array([(m & (1 << 64) - 1) - (1 << 63) for m in marks], pa.int64()), pa.array([k for _, k in sizes], pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)),
                    ],
                    ["doc_id", "n", "n1", "n2", "need", "prefix"],
                )

    rows = written(_texts(docs).mapInArrow(prefixes, "doc_id long, n long, n1 long, n2 long, need int, prefix array<long>"), "jaccard-prefixes")
    classes = rows.filter("doc_id is not null and n > 0").groupBy("n1", "n2").agg(F.min("doc_id").alias("low"), F.countDistinct("doc_id").alias("copies"), F.max("n").alias("n"))
    classes = written(classes, "jaccard-classes")
    ours = rows.filter("size(prefix) > 0").select("doc_id", "n1", "n2", "need", "prefix").join(classes.drop("n"), ["n1", "n2"]).filter("doc_id = low").select("low", "need", "prefix")
    tokens = written(ours.select("low", "need", F.explode("prefix").alias("token")), "jaccard-tokens")
    shared = written(_met(tokens), "jaccard-shared")
    discard(tokens)
    # repeated rows of a document are one set; sets that go leave shingles that no other has any more
    tokens = written(_met(_enough(shared)).distinct(), "jaccard-met")
    tokens = written(_enough(tokens), "jaccard-enough")
    places = written(dealt(meetings(tokens), classes.select("low", "n"), chunk, fewest), "jaccard-dealt")

    near = places.join(classes, "low").select("low", "copies", "n1", "n2", "places")
    few = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("n")).first().n <= MOST_BROADCAST
    near = F.broadcast(near) if few else near

    def sets(batches):
        for b in batches:
            for i, j, texts in _parts(b.column(5)):
                got = shingle_sets(texts, words)
                marks = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in got]
                wanted = zip(b.column(2)[i:j].to_pylist(), b.column(3)[i:j].to_pylist())
                same = [k for k, (m, w) in enumerate(zip(marks, wanted)) if ((m >> 64) - (1 << 63), (m & (1 << 64) - 1) - (1 << 63)) == w]
                take = pa.array([i + k for k in same], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in (0, 1, 4)), pa.array([got[k].tobytes() for k in same], pa.binary())], ["low", "copies", "places", "shingles"])

    members = _texts(docs).join(near, F.col("doc_id") == F.col("low")).select("low", "copies", "n1", "n2", "places", "text")
    at = near.schema["places"].dataType.simpleString()
    members = written(members.mapInArrow(sets, f"low long, copies long, places {at}, shingles binary"), "jaccard-sets")
    work = members.select("low", "copies", "shingles", F.explode("places").alias("p")).select("p.*", "low", "copies", "shingles")
    links = written(work.groupBy("task").applyInArrow(lambda t: joined(t, known, percent), "a long, b long, n long"), "jaccard-links")
    discard(members)

    roots = components(links.filter("a != b").select("a", "b"))
    counts = links.filter("a = b").groupBy(F.col("a").alias("low")).agg(F.sum("n").alias("linked"))
    # one id may have several texts: its component is the least of those of its texts
    owner = rows.filter("doc_id is not null and n > 0").select("doc_id", "n1", "n2").join(classes.drop("n"), ["n1", "n2"]).select("doc_id", "n1", "n2", "low", "copies")
    several = rows.filter("doc_id is not null").select("doc_id", "n1", "n2").distinct().groupBy("doc_id").count().filter("count > 1")
    if several.limit(1).count():
        extra = owner.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
        roots = components(links.filter("a != b").select("a", "b").unionByName(extra))
    classed = classes.join(roots.withColumnRenamed("node", "low"), "low", "left").join(counts, "low", "left")
    result = classed.select("n1", "n2", F.coalesce("root", "low").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "n1", "n2").join(result, ["n1", "n2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of rows: that of the smallest doc_id, null ids last; all columns as they are.

    Rows that share an id, or have none, are told apart by their texts, and equal ones are one. Of
    several rows with the same id and text the one with the smallest hash of its other columns stays.
    Texts without words, null ones too, are linked with nothing; an empty table gives no rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    again = written(ids.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), "jaccard-repeated")
    node, gone = unused(docs, "node"), unused(docs, "gone")
    if not again.limit(1).count():
        found = near_duplicates(docs, words, percent)
        worse = written(found.filter("doc_id > component_id").select(F.col("doc_id").alias(gone)), "jaccard-gone")
        return docs.join(ids_fit(worse), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    marked = again.select(F.col("doc_id").alias(gone), F.lit(True).alias(node))
    keyed = docs.join(ids_fit(marked), F.col("doc_id").cast("long").eqNullSafe(F.col(gone)), "left")
    own = F.when(F.col(node), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).otherwise(F.col("doc_id").cast("long"))
    keyed = keyed.select(*docs.columns, F.col(node).isNotNull().alias(gone), own.alias(node))
    nodes = keyed.select(F.col("doc_id").cast("long").alias("id"), F.col(node).alias("node")).distinct()
    found = near_duplicates(keyed.select(F.col(node).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("node"), "component_id").distinct()
    found = found.join(nodes, "node")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node"))["node"].alias(node))
    best = written(best.select(node), "jaccard-kept")
    kept = keyed.join(best, node, "left_semi")
    plain = [c for c in docs.columns if "map" not in docs.schema[c].dataType.simpleString()]
    once = kept.filter(gone).groupBy(node).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(gone)).select(f"`{gone}`.*")
    return kept.filter(~F.col(gone)).select(*docs.columns).unionByName(once)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
