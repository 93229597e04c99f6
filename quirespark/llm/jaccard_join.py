r"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact intersections last.

Texts with equal shingle sets form one class, and only classes are compared. Two sets can be similar enough only if
they share one of the first n - ceil(t n) + 1 shingles of any common order; the order here puts shingles that a
sample finds in many documents last, which keeps tiles small and cannot lose a link. A tile holds the classes with
one such shingle, sorted by size: only those within the size band of the threshold meet. A shingle with more classes
than a tile holds is dealt over several tiles at random; where they leave its classes in several pieces, the smaller
pieces meet all others in a second pass (their classes go to every tile of the largest piece). A signature has the parity
of the shingles hashed to each bit; the bits in which two signatures differ bound the symmetric difference from below
and so the overlap from above. What passes is joined into groups. Tiles have short signatures, in which long sets no
longer differ enough, so groups are sifted once more by signatures as long as the sets; inside what is left the sorted
arrays are intersected exactly. Classes that are connected already need no comparison, so large groups of copies cost about a
comparison per copy. A group beyond one block is connected within blocks, then between the blocks' representatives;
pairs of blocks meet only where that leaves a group in pieces.

Edge cases: null and empty text, and text without words, have an empty set and link with nothing; fewer words than a
shingle form one shingle; a null doc_id counts for links but never names a component; repeated rows stay; an empty
table gives none; a text of any length is one set, held whole in one task; columns other than doc_id and text never
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, steps, stored, whole_groups
from .components import components
from .wordhash import hashed_words, mix

WORDS, PERCENT = 5, 80
#: Bits of the signatures in tiles, and of those that a group's arrays are compared by before exact intersection.
BITS, LONG_BITS = 512, 8192
#: One document in SAMPLE_PART gives the order of shingles; at most HOT of them are put last.
SAMPLE_PART, HOT = 20, 200_000
#: Ids of representatives and of components up to this many (8 and 24 bytes each) are sent to scans; more are joined.
SENT_IDS = 1_000_000
#: Classes of a group, and their shingles, that a block holds; larger groups are connected block by block.
BLOCK, BLOCK_SHINGLES = 8192, 1 << 21
#: Classes of a group, and bytes of their sized signatures, that a block of the sift holds.
SIFTED, SIFTED_BYTES = 1 << 15, 1 << 24
#: Classes that a tile of a frequent shingle holds about; those of a shingle with more are dealt over several tiles.
TILE = 1024
#: Bytes of signatures that one comparison gathers at once.
GATHERED = 1 << 24


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles."""
    h, bounds, *_ = hashed_words(texts, lower=True)
    n = len(h)
    window = h[: max(0, n - k + 1)].copy()
    for j in range(1, k):
        window = mix(window) + h[j : n - k + 1 + j]
    window = mix(window)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(window[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            one = np.uint64(b - a)
            for w in h[a:b]:
                one = mix(mix(np.array([one], np.uint64)) + w)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = mix(s ^ np.uint64(0x5DEECE66D5DEECE6)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b ^ np.uint64(len(s))).to_bytes(8, "big")


def signature(s: np.ndarray, bits: int = BITS) -> bytes:
    """Parity of the hashes at each bit."""
    return np.packbits((np.bincount((s >> np.uint64(17)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def level_of(n: int) -> int:
    """Log 2 of the bits of a set's sized signature: a bit a shingle at least."""
    return max(BITS.bit_length(), (n - 1).bit_length() + 1) - 1


def folded(raw: bytes, bits: int) -> np.ndarray:
    """A signature as bytes of `bits` bits: halves of a longer one add up to the parities of fewer bits."""
    out = np.frombuffer(raw, np.uint8)
    while 8 * len(out) > bits:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def enough(n: int, percent: int) -> int:
    """Fewest common shingles of a set of n with a similar one."""
    return -(-percent * n // 100)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that a sample holds three times or more, by count; at most HOT. Only the order of prefixes rests on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in steps(batches):
            every = np.concatenate([*shingle_sets(texts, k), np.zeros(0, np.uint64)])
            s, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], ["s", "n"])

    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PART)) == 0)
    counts = sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n >= 3")
    rows = counts.orderBy(F.desc("n"), "s").limit(HOT).toPandas()
    rows = rows.sort_values(["n", "s"], ascending=[False, True])
    return rows["s"].to_numpy(np.int64).view(np.uint64)


def _features(k: int, percent: int, hot_sent):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("signature", pa.binary()), ("prefix", pa.binary()), ("level", pa.int32()), ("sized", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_sent.value
        order = np.argsort(hot)
        ranked = hot[order]
        for batch in batches:
            names = iter(batch.column(2).to_pylist())
            for ids, texts in steps([batch]):
                rows = []
                for i, s in zip(ids, shingle_sets(texts, k), strict=True):
                    length = len(s) - enough(len(s), percent) + 1 if len(s) else 0
                    prefix = s
                    if len(ranked) and len(s):
                        at = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
                        # the most frequent come last: their place in `hot` counts backwards
                        place = np.where(ranked[at] == s, len(ranked) - order[at], 0)
                        if place.any():
                            prefix = s[np.argsort(place, kind="stable")]
                    rows.append((i, next(names), len(s), set_key(s), signature(s), prefix[:length].tobytes(), level_of(len(s)), signature(s, 1 << level_of(len(s)))))
                yield _batch(rows, schema)

    return run


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token, node and n of each posting of (key, n, prefix); a node is the first half of a key."""
    for batch in batches:
        tokens = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(2)]
        sizes = [*map(len, tokens)]
        nodes = np.array([int.from_bytes(x.as_py()[:8], "big", signed=True) for x in batch.column(0)], np.int64)
        yield np.concatenate([*tokens, np.zeros(0, np.int64)]), np.repeat(nodes, sizes), np.repeat(batch.column(1).to_numpy(), sizes).astype(np.int32)


def _among(known: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token stands among the sorted known ones, and whether it is one."""
    if not len(known):
        return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return at, known[at] == tokens


def _only(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of the tokens sent."""
        known = sent.value[0]
        for columns in _posted(batches):
            own = _among(known, columns[0])[1]
            yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in columns], ["token", "node", "n"])

    return run


def _tiled(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tile, node, n): a tile per token, or for the tokens sent one of several."""
        known, parts = sent.value
        for token, node, n in _posted(batches):
            at, own = _among(known, token)
            spot = np.flatnonzero(own)
            part = mix(node[spot].view(np.uint64) ^ token[spot].view(np.uint64)) % parts[at[spot]]
            token = token.copy()
            token[spot] = mix(mix(token[spot].view(np.uint64)) + part).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token, node, n)], ["tile", "node", "n"])

    return run


def frequent_tokens(postings: DataFrame, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the hot shingles those with more classes than a tile holds, sorted, and the number of their tiles."""
    sent = postings.sparkSession.sparkContext.broadcast((np.sort(hot.view(np.int64)), None))
    counts = postings.mapInArrow(_only(sent), "token long, node long, n int").groupBy("token").count().where(F.col("count") > TILE)
    rows = counts.orderBy("token").toPandas()  # at most HOT
    return rows["token"].to_numpy(np.int64), -(-rows["count"].to_numpy(np.int64) // TILE).astype(np.uint64)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _shared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (tile, node, n), sorted by tile and n, whose tile has another class within the size band."""
        for batch in whole_groups(batches, "tile"):
            tile, node, n = (_column(batch, c) for c in ("tile", "node", "n"))
            near = (tile[1:] == tile[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            keep = np.concatenate((near, [False])) | np.concatenate(([False], near))
            yield pa.RecordBatch.from_arrays([pa.array(tile[keep]), pa.array(node[keep])], ["tile", "node"])

    return run


class Forest:
    """Union of rows by arrays: every root is the smallest row of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def connect(group: np.ndarray, n: np.ndarray, signatures: list[np.ndarray], percent: int, exact=None, made: Forest | None = None) -> Forest:
    """Joins rows of a group (rows sorted by group and n) that the signatures, and `exact` if given, find similar.

    Each pass compares rows a fixed distance apart; pairs that are connected already, or too different in size, drop
    out, and a pass without partners within the size band ends the loop. `made` may have rows joined before.
    """
    made = made or Forest(len(group))
    rows, d = np.arange(len(group)), 1
    chunk = max(1, GATHERED // max(bits.shape[1] * bits.itemsize for bits in signatures))
    last = np.searchsorted(group, group, "right") - 1
    while len(rows):
        rows = rows[rows + d <= last[rows]]
        rows = rows[100 * n[rows] >= percent * n[rows + d]]
        apart = rows[made.root[rows] != made.root[rows + d]]
        for k in range(0, len(apart), chunk):
            a = apart[k : k + chunk]
            for bits in signatures:  # from short ones to long ones
                differ = np.bitwise_count(bits[a] ^ bits[a + d]).sum(1, dtype=np.int64)
                # similar sets of sizes x and y differ in at most (x + y) (100 - p) / (100 + p) shingles
                a = a[differ * (100 + percent) <= (n[a] + n[a + d]) * (100 - percent)]
            if exact is not None:
                for r in a.tolist():
                    if made.root[r] != made.root[r + d] and exact(r, r + d):
                        made.join(np.array([r]), np.array([r + d]))
            else:
                made.join(a, a + d)
        d += 1
    return made


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges from each class of a tile to the smallest one that the signatures connect it with; rows of one piece
        are connected already. Rows are sorted by tile, n and node."""
        for batch in whole_groups(batches, "tile"):
            tile, node, n, piece = (_column(batch, c) for c in ("tile", "node", "n", "piece"))
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(len(tile), -1)
            made = Forest(len(tile))
            near = np.lexsort((piece, tile))
            same = (piece[near[1:]] == piece[near[:-1]]) & (tile[near[1:]] == tile[near[:-1]])
            made.join(near[1:][same], near[:-1][same])
            root = connect(tile, n.astype(np.int64), [signatures], percent, made=made).root
            least = node.copy()
            np.minimum.at(least, root, node)
            a, b = node, least[root]
            pairs = np.unique(np.column_stack((a, b))[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def second_pass(postings: DataFrame, groups: DataFrame, sent) -> DataFrame:
    """(tile, node, n, piece) of the frequent tokens whose tiles left their classes in several pieces.

    The largest piece of a token is cut into `m` parts, all others together into `r`; every part of the others meets
    every part, so pairs within the largest piece, which are connected already, are not met again.
    """
    rows = postings.mapInArrow(_only(sent), "token long, node long, n int").join(groups, "node", "left")
    rows = stored(rows.select("token", "node", "n", F.coalesce("component", "node").alias("piece")), "jaccard-frequent")
    by_piece = rows.groupBy("token", "piece").agg(F.count("*").alias("c"))
    tokens = by_piece.groupBy("token").agg(F.max(F.struct("c", "piece")).alias("main"), F.sum("c").alias("total")).where("total > main.c")
    parts = lambda c: F.ceil(c / TILE).cast("int")
    tokens = tokens.select("token", "main.piece", parts(F.col("main.c")).alias("m"), parts(F.col("total") - F.col("main.c")).alias("r"))
    met = rows.join(tokens.withColumnRenamed("piece", "main"), "token").withColumn("in_main", F.col("piece") == F.col("main"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node", "token"), F.when(F.col("in_main"), F.col("m")).otherwise(F.col("r"))).cast("int"))
    with_main = F.expr("transform(sequence(0, if(in_main, r, m) - 1), j -> xxhash64(token, 0, if(in_main, own, j), if(in_main, j, own)))")
    with_rest = F.expr("if(in_main, array(), transform(sequence(0, r - 1), j -> xxhash64(token, 1, least(own, j), greatest(own, j))))")
    return met.select(F.explode(F.concat(with_main, with_rest)).alias("tile"), "node", "n", "piece")


def _sift(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges like those of tiles, by sized signatures; the rows of a block share one level and are sorted by it."""
        for batch in whole_groups(batches, "block"):
            block, at, node, n = (_column(batch, c) for c in ("block", "at", "node", "n"))
            raw = batch.column("sized")
            order = np.lexsort((node, n, block, at))
            block, at, node, n = block[order], at[order], node[order], n[order].astype(np.int64)
            ends = np.flatnonzero(np.diff(at)) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(at)], strict=True):
                bits = np.stack([folded(raw[j].as_py(), 1 << int(at[a])) for j in order[a:b].tolist()]).view(np.uint64)
                root = connect(block[a:b], n[a:b], [bits], percent).root
                rows = np.flatnonzero(root != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b][rows]), pa.array(node[a:b][root[rows]])], ["a", "b"])

    return run


def sifted(members: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the parts that sized signatures leave connected in each component of members."""
    below = F.expr(f"level > {level_of(1)} and {percent} * n <= 100 * shiftleft(1L, level - 1)")
    at = F.explode(F.when(below, F.array("level", F.col("level") - 1)).otherwise(F.array("level"))).alias("at")
    each = members.select("component", "node", "n", "sized", at)
    sizes = each.groupBy("component", "at").agg(F.ceil(F.greatest(F.count("*") / SIFTED, F.sum(F.length("sized")) / SIFTED_BYTES)).cast("int").alias("blocks"))
    dealt = each.join(sizes, ["component", "at"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    block = F.expr("xxhash64(component, at, least(own, other), greatest(own, other))").alias("block")
    rows = dealt.select(block, "at", "node", "n", "sized").repartition("block").sortWithinPartitions("block")
    return components(rows.mapInArrow(_sift(percent), "a long, b long"))


def _arrays(k: int):
    schema = pa.schema([("key", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            yield _batch([(set_key(s), s.tobytes()) for s in shingle_sets(texts, k)], schema)

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges between keys of a block whose arrays are similar, one to the first of what is connected. Rows are
        sorted by block, n and key."""
        for batch in whole_groups(batches, "block"):
            block, key, n, piece = (_column(batch, c) for c in ("block", "key", "n", "piece"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
            signatures = [np.frombuffer(b"".join(signature(x, b) for x in sets), np.uint64).reshape(len(sets), -1) for b in (BITS, LONG_BITS)]

            def similar(a: int, b: int, sets=sets) -> bool:
                both = np.concatenate((sets[a], sets[b]))
                both.sort(kind="stable")  # merges two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                return 100 * common >= percent * (len(both) - common)

            made = Forest(len(sets))
            of = np.unique(piece, return_inverse=True)[1]
            near = np.lexsort((of, block))
            same = (of[near[1:]] == of[near[:-1]]) & (block[near[1:]] == block[near[:-1]])
            made.join(near[1:][same], near[:-1][same])
            root = connect(block, n, signatures, percent, similar, made).root
            rows = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(key[rows].tolist(), pa.binary()), pa.array(key[root[rows]].tolist(), pa.binary())], ["a", "b"])

    return run


def _sized(rows: DataFrame) -> DataFrame:
    """The rows with the number of blocks of their component, and their own block."""
    sizes = rows.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return rows.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("key", "component"), F.col("blocks")).cast("int"))


def exact_links(members: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of keys whose transitive closure is that of all similar pairs within each component.

    `members` has key, n and component, `arrays` key and hashes; arrays move by key and by block, all else is decided
    on members. Blocks come first; what spans more than one block goes on with one representative a piece, and only
    components that are then still in pieces are dealt out as pairs of blocks.
    """

    def meet(rows: DataFrame, block) -> DataFrame:
        met = arrays.join(rows.select("key", "n", "piece", block.alias("block")), "key")
        return met.repartition("block").sortWithinPartitions("block", "n", "key").mapInArrow(_exact(percent), "a binary, b binary")

    rows = stored(_sized(members.withColumn("piece", F.col("key"))), "jaccard-members")
    own = F.xxhash64("component", "own")
    links = stored(meet(rows, own), "links")
    wide = rows.where("blocks > 1").select("key", "n", "component")
    if wide.isEmpty():
        return links
    arrays = stored(arrays.join(wide.select("key"), "key", "left_semi"), "jaccard-arrays")

    def pieces(links: DataFrame) -> DataFrame:
        named = components(links).select(F.col("node").alias("key"), F.col("component").alias("piece"))
        return wide.join(named, "key", "left").withColumn("piece", F.coalesce("piece", "key"))

    links = stored(links.union(meet(_sized(pieces(links).where("key = piece")), own)), "links")
    now = pieces(links)
    open_ = now.groupBy("component").agg(F.min("piece").alias("x"), F.max("piece").alias("y")).where("x <> y").select("component")
    left = _sized(now.join(open_, "component", "left_semi"))
    dealt = left.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    pair = F.expr("xxhash64(component, least(own, other), greatest(own, other))")
    return links.union(meet(dealt, pair))


def linked_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles, component (a key; null for an empty set) and component_id of every row of (doc_id, text, row)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    hot = frequent(docs, k)
    hot_sent = spark.sparkContext.broadcast(hot)  # at most HOT values
    features = docs.mapInArrow(_features(k, percent, hot_sent), "doc_id long, row long, n long, key binary, signature binary, prefix binary, level int, sized binary")
    features = stored(features, "jaccard-features")
    some = features.where("n > 0")
    classes = some.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("prefix").alias("prefix"), F.first("level").alias("level"), F.first("sized").alias("sized"))
    classes = stored(classes, "jaccard-classes")
    node = F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("long")

    # tiles: postings meet by tile, once bare and then, where a tile is shared, with signatures
    postings = classes.select("key", "n", "prefix")
    tiles_of = spark.sparkContext.broadcast(frequent_tokens(postings, hot))
    signatures = classes.select(node.alias("node"), "n", "signature")

    def edges(signed: DataFrame) -> DataFrame:
        dealt = signed.repartition("tile").sortWithinPartitions("tile", "n", "node")
        return dealt.mapInArrow(_tiles(percent), "a long, b long")

    tiled = postings.mapInArrow(_tiled(tiles_of), "tile long, node long, n int").repartition("tile").sortWithinPartitions("tile", "n")
    shared = tiled.mapInArrow(_shared(percent), "tile long, node long")
    met = stored(edges(shared.join(signatures, "node").withColumn("piece", F.col("node"))), "jaccard-edges")
    groups = components(met)
    if len(tiles_of.value[0]):
        again = second_pass(postings, groups, tiles_of).drop("n").join(signatures, "node")
        groups = components(met.union(edges(again)))
    groups = stored(groups, "jaccard-groups")

    # exact: only representatives of classes in groups are read again
    groups = sifted(classes.select(node.alias("node"), "n", "level", "sized").join(groups, "node"), percent)
    wanted = stored(classes.select(node.alias("node"), "key", "n", "doc_id").join(groups, "node"), "jaccard-wanted")
    ids = wanted.select("doc_id").distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    arrays = docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("doc_id", "text").mapInArrow(_arrays(k), "key binary, hashes binary").dropDuplicates(["key"])
    linked = components(exact_links(wanted.select("key", "n", "component"), arrays, percent))

    # the smallest id of each component, handed to its classes and then to all copies
    named = classes.select("key", "doc_id").join(linked.withColumnRenamed("node", "key"), "key")
    least = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    if least.count() <= SENT_IDS:
        least = F.broadcast(least)
    joined = named.join(least, "component").select("key", "component", "component_id")
    of_class = classes.select("key", "doc_id").join(joined, "key", "left")
    of_class = of_class.select("key", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    rows = features.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key"))
    return rows.join(of_class, "key", "left").select("doc_id", "row", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links of similarity >= percent reach)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("row"))
    return linked_rows(source, k, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, of one document of each component: the one of smallest id, nulls last.

    Where an id repeats within a component, the row whose columns have the smallest hash stays, and of wholly equal
    rows one. Rows without words are linked with nothing and all stay.
    """
    name = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), name.alias("row"))
    rows = linked_rows(source, k, percent)
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    bare = rows.where("component is null").select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row"), F.lit(False).alias("one"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.row").alias("kept_row"), F.lit(True).alias("one")).union(bare).distinct()
    # equal rows are told by their number, so texts move only where there are any
    copies = stored(rows.groupBy("doc_id", "row").agg(F.count("*").alias("copies")).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row"))).select("kept_id", "kept_row", (F.col("one") & (F.col("copies") > 1)).alias("again")), "jaccard-kept")
    taken, own_id, own_row = {c.lower() for c in docs.columns}, "kept_id", "kept_row"
    while own_id in taken or own_row in taken:
        own_id, own_row = own_id + "_", own_row + "_"

    def kept_rows(again: bool) -> DataFrame:
        own = copies.where(F.col("again") == again).select(F.col("kept_id").alias(own_id), F.col("kept_row").alias(own_row))
        return docs.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (name == F.col(own_row)), "left_semi")

    if copies.where("again").isEmpty():
        return kept_rows(False)
    return kept_rows(False).union(kept_rows(True).dropDuplicates())
