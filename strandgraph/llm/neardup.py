"""MinHash near-dedup with DartMinHash: hashed darts thrown into weighted element regions.

An element is a shingle of five words (fewer words: the whole text); its weight is its number of occurrences, so a text's
region is a union of unit cells (shingle, occurrence). Into each unit square of cell x rank falls a Poisson(1) number of
darts, at places that are hashes of the square alone. A text looks at its darts of rank below `darts / weight`; the
earliest dart of each of COORDINATES coordinates is its signature, alike in two texts with the probability of their
weighted Jaccard similarity. Where a coordinate has no dart yet, the text's rank limit is doubled.

Joining: BANDS hashes of ROWS coordinates are the bucket keys. In a bucket every text is compared with three pivots: the
member that shares most buckets with others (the original of a family of near copies, most likely) and those of the extreme
keys. Candidate pairs are verified by their exact weighted Jaccard similarity, and linked texts form classes. A bucket in
which texts of several classes were no pivots holds pairs that nobody has compared. All its texts are joined again,
exactly: two texts of SIMILARITY share one of each text's rarest cells (its prefix), so texts meet in groups by prefix
cell, where each is compared with pivots of other classes and of a fitting size; those pivots are done then, and PIVOTS
times as many follow, until no group holds several classes. So of texts that share a bucket no link is lost, and copies, or
near copies of one class, never make pairs among themselves.

Defined results: null counts as the empty text; texts without words are alike only if they are equal; ties have similarity
1; repeated rows are copies, and one row of a class is kept; a class is named by its smallest doc_id (null only if all are
null). An empty table gives no rows. The verification counts cells by 32 bits of their hash: two texts of n cells share by
chance about n*n/2**32.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import discard, hot_join, map_arrow, materialize, table, unused

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
COORDINATES = BANDS * ROWS
#: Darts that a text looks at, on average: enough that all coordinates have one but for about one text in ten.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 2))
#: So many keys of candidate texts are broadcast at most (some 50 MB); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Slots in which cells are counted to find each text's rarest: that many numbers go through the driver, at any size.
SLOTS = 1 << 20
#: Pivots of a prefix group in its first round; each further round takes so many times as many.
PIVOTS = 64
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def cells(h: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's cells (shingle, occurrence), and the offset of each text's first."""
    counts = np.diff(word_off)
    x, at = T.windows(h, word_off, WORDS)
    row = np.searchsorted(word_off, at, side="right") - 1
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        x = np.concatenate([x, T.sequence_hash(h, word_off, 5)[few]])
        row = np.concatenate([row, few])
    # 44 bits of the hash below the row's number: one sort groups the rows, and the repeats within a row
    key = np.sort((row.astype(np.uint64) << T.U(44)) | (x >> T.U(20)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    place = np.arange(len(key))
    repeat = place - np.maximum.accumulate(np.where(first, place, 0)) if len(key) else place
    off = np.searchsorted(key, np.arange(len(counts) + 1, dtype=np.uint64) << T.U(44))
    return T.mix((key & T.U((1 << 44) - 1)) * T.U(0x9E3779B97F4A7C15) + repeat.astype(np.uint64) * T.U(0xC2B2AE3D27D4EB4F)), off


def _earliest(cell: np.ndarray, off: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each text and coordinate the identity of the dart of least rank below the text's limit; 0: none."""
    n = len(off) - 1
    squares = np.ceil(limit).astype(np.int64)
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    if (squares > 1).any():
        times = squares[row]
        base = np.repeat(cell, times)
        rank0 = np.arange(len(base)) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat(row, times)
    else:
        base, rank0 = cell, np.zeros(len(cell), np.int64)
    square = T.mix(base + rank0.astype(np.uint64) * T.U(0xA0761D6478BD642F))
    u = (square >> T.U(11)).astype(np.float64) * 2.0**-53
    darts = np.searchsorted(_POISSON, u, side="right")
    which = np.repeat(np.arange(len(square)), darts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = T.mix(square[which] ^ ((number.astype(np.uint64) + T.U(1)) * T.U(0xE7037ED1A0B428DB)))
    rank = rank0[which] + (dart >> T.U(24)).astype(np.float64) * 2.0**-40
    ok = rank < limit[row[which]]
    dart, rank, row = dart[ok], rank[ok], row[which[ok]]
    slot = row * COORDINATES + ((dart & T.U(0xFFFFFF)) % T.U(COORDINATES)).astype(np.int64)
    best = np.full(n * COORDINATES, np.inf)
    np.minimum.at(best, slot, rank)
    out = np.zeros(n * COORDINATES, np.uint64)
    win = rank == best[slot]
    out[slot[win]] = dart[win] | T.U(1)
    return out.reshape(n, COORDINATES)


def signatures(cell: np.ndarray, off: np.ndarray) -> np.ndarray:
    """DartMinHash signatures, a row for each text; texts without cells have zeros."""
    size = np.diff(off)
    limit = DARTS / np.maximum(size, 1)
    out = _earliest(cell, off, limit)
    while len(open_ := np.flatnonzero((size > 0) & (out == 0).any(axis=1))):
        limit[open_] *= 2
        own = np.concatenate([cell[off[i] : off[i + 1]] for i in open_])
        out[open_] = _earliest(own, np.concatenate([[0], np.cumsum(size[open_])]), limit[open_])
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    x = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        x = T.mix(x * T.U(0x8EBC6AF09C88C6E3) + signature[:, k::ROWS])
    return T.mix(x + np.arange(1, BANDS + 1, dtype=np.uint64) * T.U(0x589965CC75374CC3)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, raw (hash of the text), key (63-bit hash of its words), bands and the sorted cells, for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, off = T.views(b["text"])
            for i, j in T.row_blocks(off):
                h, _, _, word_off = T.words(data, off[i : j + 1])
                key = T.sequence_hash(h, word_off, 11)
                bare = np.diff(word_off) == 0
                raw = b["raw"].slice(i, j - i).to_numpy(zero_copy_only=False)
                key[bare] = T.mix(raw[bare].view(np.uint64) + T.U(77))
                cell, cell_off = cells(h, word_off)
                keys = bands(signatures(cell, cell_off))
                some = ~bare
                small = (cell >> T.U(32)).astype(np.uint32)
                packed = [np.sort(small[a:z]).tobytes() for a, z in zip(cell_off[:-1], cell_off[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(i, j - i), pa.array(raw), pa.array((key >> T.U(1)).view(np.int64)), lists, pa.array(packed, pa.binary())],
                    ["doc_id", "raw", "key", "bands", "cells"],
                )

    text = F.coalesce("text", F.lit(""))
    return map_arrow(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("raw")), run, f"doc_id {kind}, raw bigint, key bigint, bands array<bigint>, cells binary")


def verified(pairs: DataFrame, cells_of: DataFrame) -> DataFrame:
    """The pairs (a, b) of SIMILARITY or more: exact weighted Jaccard, cells shared by cells of either."""
    # a pivot of a large group of near copies is in very many pairs
    one = hot_join(pairs, cells_of.select(F.col("key").alias("a"), F.col("cells").alias("a_cells")), "a")
    both = (
        hot_join(one, cells_of.select(F.col("key").alias("b"), F.col("cells").alias("b_cells")), "b", pairs)
        # texts whose sizes alone rule the similarity out need no comparison
        .filter(F.least(F.length("a_cells"), F.length("b_cells")) >= SIMILARITY * F.greatest(F.length("a_cells"), F.length("b_cells")))
    )

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b["a_cells"], b["b_cells"])):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                z = np.concatenate([x, y])
                z.sort()
                shared = int((z[1:] == z[:-1]).sum())
                keep[k] = shared >= SIMILARITY * (len(x) + len(y) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(keep))

    return map_arrow(both.select("a", "b", "a_cells", "b_cells"), run, "a bigint, b bigint")


def cells_by_key(sketch: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, cells) of the texts asked for; copies of one text count once."""
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return sketch.select("key", "cells").join(keys, "key", "left_semi").groupBy("key").agg(F.first("cells").alias("cells"))


def links(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The verified ones of pairs (a, b), written."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "ends")
    cells_of = materialize(cells_by_key(sketch, ends), "cells")
    found = materialize(verified(pairs, cells_of), "links")
    discard(ends, cells_of)
    return found


def shared_buckets(members: DataFrame) -> DataFrame:
    """From (grp, key): the rows of groups that hold several keys, with the number of members; written."""
    sizes = materialize(members.groupBy("grp").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("__n")).filter("lo <> hi").select("grp", "__n"), "buckets")
    out = materialize(hot_join(members, sizes.select("grp", F.col("__n").alias("n")), "grp", sizes), "shared")
    discard(sizes)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): connected components by contraction to the smallest neighbour.

    Each round maps nodes to the least of themselves and their neighbours and contracts the edges; rounds end when no edge
    is left. Nothing is collected, and each round's tables are written to the shared folder.
    """
    nodes, own = None, None
    while True:
        step = materialize(
            edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
            .groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")),
            "step",
        )
        if step.isEmpty():
            return nodes if nodes is not None else step.select("node", F.col("to").alias("root"))
        # one jump to the neighbour's own choice halves long chains
        jump = materialize(hot_join(step, step.select(F.col("node").alias("to"), F.col("to").alias("root")), "to").select("node", "root"), "jump")
        before, nodes = nodes, jump if nodes is None else renamed(nodes, jump)
        left = hot_join(edges, jump.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        both = hot_join(left, jump.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", edges)
        rest = materialize(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "edges")
        discard(step, *(t for t in (own, before) if t is not None))
        own = edges = rest


def renamed(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes(node, root) with roots replaced by their root in names(node, root), where they have one; written."""
    moved = nodes.select("root").distinct().join(names.select(F.col("node").alias("root"), F.col("root").alias("to")).hint("merge"), "root", "left")
    return materialize(hot_join(nodes, moved, "root").select("node", F.coalesce("to", "root").alias("root")), "nodes")


def merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, root) of earlier roots and further links (a, b): the components of classes, by the links between them."""
    if roots is None:
        return components(found)
    for end in ("a", "b"):
        found = found.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")).hint("merge"), end, "left")
    ends = [F.coalesce(f"root_{end}", end) for end in ("a", "b")]
    between = materialize(found.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).filter("a <> b").distinct(), "between")
    names = components(between)
    out = renamed(roots, names).unionByName(names.join(roots.select("node").hint("merge"), "node", "left_anti"))
    return materialize(out, "roots")


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows(grp, key, ...) with each key's root, only of groups that hold several roots; written."""
    rows = rows.join(roots.select(F.col("node").alias("key"), "root").hint("merge"), "key", "left") if roots is not None else rows.withColumn("root", F.lit(None).cast("long"))
    rows = materialize(rows.withColumn("root", F.coalesce("root", "key")), "rooted")
    several = rows.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("__n")).filter("lo <> hi").select("grp", "__n")
    several = materialize(several, "several")
    out = materialize(hot_join(rows, several.select("grp"), "grp", several), "open")
    discard(rows, several)
    return out


def rare_cells(texts: DataFrame) -> DataFrame:
    """From texts(key, cells): (grp, key, n, place) for each cell of each text's prefix, its rarest cells among these texts;
    n cells has the text, and `place` of them are rarer.

    A text of n cells and one of SIMILARITY to it share SIMILARITY * n of them or more, so one of the n - SIMILARITY * n + 1
    rarest by any one order of cells. The order here is by counts in SLOTS slots of the cell's hash, then by the cell.
    """

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b["cells"]:
                np.add.at(total, np.frombuffer(x.as_buffer(), np.uint32) >> 12, 1)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 1 << 16):
            at = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    sums = map_arrow(texts.select("cells"), count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS, np.int64)
    total[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(np.minimum(np.log2(total + 1.0) * 8, 255).astype(np.uint8))

    def prefix(batches):
        often = held.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                keys, groups, sizes, places = [], [], [], []
                for key, x in zip(b["key"].slice(i, 256).to_pylist(), b["cells"].slice(i, 256)):
                    x = np.unique(np.frombuffer(x.as_buffer(), np.uint32))
                    n = len(x) - int(np.ceil(SIMILARITY * len(x) - 1e-9)) + 1
                    order = np.lexsort((x, often[x >> 12]))[:n]
                    groups.append(x[order].astype(np.int64))
                    keys.append(np.full(len(order), key, np.int64))
                    sizes.append(np.full(len(order), len(x), np.int32))
                    places.append(np.arange(len(order), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (groups, keys, sizes, places)], ["grp", "key", "n", "place"])

    return map_arrow(texts.select("key", "cells"), prefix, "grp bigint, key bigint, n int, place int")


def fitting(n: str, place: str, m: str, other: str) -> str:
    """If texts of n and m cells can be of SIMILARITY whose first common cell has these places in their prefixes."""
    share = SIMILARITY / (1 + SIMILARITY)
    return f"least({n}, {m}) >= {SIMILARITY} * greatest({n}, {m}) - 1e-6 AND least({n} - {place}, {m} - {other}) >= {share} * ({n} + {m}) - 1e-6"


def exact_rest(rows: DataFrame, sketch: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """Roots after every pair of different classes among the keys of rows(grp, key, root) has been settled exactly."""
    keys = materialize(rows.select("key").distinct(), "asked")
    texts = materialize(cells_by_key(sketch, keys), "texts")
    own, tried, pivots = materialize(rare_cells(texts), "prefixes"), None, PIVOTS
    rest = own
    while True:
        opened = with_roots(rest, roots)
        if opened.isEmpty():
            break
        # members of small classes first: once compared, they leave the fewest classes behind
        sized = opened.join(opened.groupBy("grp", "root").agg(F.count("*").alias("m")).hint("merge"), ["grp", "root"])
        picked = sized.groupBy("grp", F.pmod(F.xxhash64("key", F.lit(pivots)), F.lit(pivots)).alias("sub")).agg(F.min(F.struct("m", "key", "root", "n", "place")).alias("p"))
        picked = materialize(picked.select("grp", F.col("p.key").alias("pivot"), F.col("p.root").alias("p_root"), F.col("p.n").alias("p_n"), F.col("p.place").alias("p_place")), "picked")
        met = hot_join(opened, picked, "grp").filter("root <> p_root").filter(fitting("n", "place", "p_n", "p_place"))
        met = met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        fresh = materialize(met if tried is None else met.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = fresh if tried is None else tried.unionByName(fresh)
        found = links(fresh, sketch)
        if not found.isEmpty():
            roots = merged(roots, found)
        # a pivot has met all its group
        rest = materialize(opened.drop("root").join(picked.select("grp", F.col("pivot").alias("key")), ["grp", "key"], "left_anti"), "rest")
        discard(opened, picked)
        pivots *= PIVOTS
    discard(keys, texts, own)
    return roots


def classes(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, raw, key, rid (its own number), class_key (the same for all of a class)."""
    sketch = materialize(sketches(docs).withColumn("rid", F.monotonically_increasing_id()), "sketch")
    # copies share a key and its bands
    texts = materialize(sketch.groupBy("key").agg(F.first("bands").alias("bands")), "texts")
    shared = shared_buckets(texts.select(F.explode("bands").alias("grp"), "key"))
    central = shared.groupBy("key").agg(F.sum("n").alias("score"))
    picked = shared.join(central.hint("merge"), "key").groupBy("grp").agg(F.max(F.struct("score", "key")).alias("top"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    picked = materialize(picked.select("grp", F.col("top.key").alias("top"), "lo", "hi"), "picked")
    ranked = materialize(hot_join(shared.select("grp", "key"), picked, "grp", shared.select("grp")), "ranked")
    met = ranked.select("key", F.explode(F.array("top", "lo", "hi")).alias("pivot")).filter("key <> pivot")
    pairs = materialize(met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), "pairs")
    found = links(pairs, sketch)
    roots = None if found.isEmpty() else components(found)
    rest = with_roots(ranked.filter("key NOT IN (top, lo, hi)").select("grp", "key"), roots)
    discard(picked)
    if not rest.isEmpty():
        roots = exact_rest(rest, sketch, roots)
    discard(shared, ranked, pairs, rest)
    base = sketch.select("doc_id", "raw", "key", "rid")
    if roots is None:
        return base.withColumn("class_key", F.col("key"))
    named = texts.select("key").join(roots.hint("merge"), F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("class_key"))
    return hot_join(base, named, "key").select("doc_id", "raw", "key", "rid", "class_key")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_docs of the class, and whether this row is kept for its class."""
    rows = materialize(classes(docs), "classes")
    named = rows.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "raw", "rid")).alias("best"))
    return hot_join(rows, named, "class_key").select("doc_id", "class_id", "n_docs", (F.col("rid") == F.col("best.rid")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id, with all its columns; of equal (doc_id, text) rows any one."""
    rows = materialize(classes(docs), "classes")
    # of rows that share a doc_id (or have none) the least text hash stays
    same = rows.groupBy("class_key", "doc_id", "raw").agg(F.count("*").alias("n"))
    best = same.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "raw", "n")).alias("m"))
    best = materialize(best.select(F.col("m.doc_id").alias("kept_id"), F.col("m.raw").alias("kept_raw"), (F.col("m.n") > 1).alias("kept_twice")), "kept")
    raw, kept_id, kept_raw, twice = unused(docs.columns, "raw", "kept_id", "kept_raw", "kept_twice")
    best = best.toDF(kept_id, kept_raw, twice)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    hit = docs.withColumn(raw, text).join(best, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(raw) == F.col(kept_raw)))
    if best.filter(twice).isEmpty():
        return hit.select(*(F.col(f"`{c}`") for c in docs.columns))
    hit = materialize(hit.drop(kept_id, kept_raw), "hit")
    one = hit.filter(twice).dropDuplicates(["doc_id", raw])
    return hit.filter(~F.col(twice)).unionByName(one).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
