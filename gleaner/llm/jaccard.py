"""N-gram Jaccard join as a blocked sparse matrix product.

The rows of the incidence matrix are documents, the columns distinct word
n-grams.  Documents with equal n-gram sets collapse to one row (a node).

* Columns: n-grams are ordered from rare to frequent (frequent ones are those
  of a sample of the texts; any order is right, this one keeps columns short).
  Two sets of which one holds ``m`` n-grams reach the threshold only if they
  share one of the first ``m - ceil(t m) + 1`` of each, so only these columns
  are multiplied.  The place of the first shared n-gram in a set bounds the
  size of the other set; rows of a column in order of size are cut where no
  pair can reach across, and each cut is a column of its own.  Rows alone in
  theirs go.  A column of up to ``ROW_BLOCK`` rows gives all its pairs.
* A longer column first pairs its rows with a few pivot rows of each size
  class.  The rows that this leaves outside the column's main component are
  then held, block by block, against all rows of other components; a block
  gives only the pairs that the bounds below allow, and leaves a pair to an
  earlier column that holds both rows: each row brings the EARLIER columns
  before this one, so a pair is always given by the first column it shares.
  First a row gives its NEAREST pairs of a block; once these are linked, all
  pairs that are still in different components.
* Pairs are discarded by size, then by parity bitmaps: the bits in which two
  bitmaps differ are a lower bound of the n-grams in which the sets differ.
* The rest is multiplied in tiles, one row against a block of rows, counting
  overlaps; a pair links at ``threshold * union`` (exact integers).  Only
  verified links are closed into components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.common import Stages, session
from gleaner.llm.graph import components

NGRAM = 3
PERCENT = 90
#: Rows of a column that are paired directly.
ROW_BLOCK = 3
#: Pivot rows of each size class of a longer column.
PIVOTS = 1
#: Rows in a tile beside its own row.
TILE = 256
#: Rows in a block of the second pass over a longer column.
BLOCK = 512
#: Earlier columns that a row brings into a block (8 bytes each); more only save repeated pairs.
EARLIER = 32
#: Pairs of a row that a block gives before components are found again.
NEAREST = 2
#: One text in SAMPLE is read for the order of columns; at most FREQUENT n-grams count as frequent (8 bytes each, broadcast).
SAMPLE = 16
FREQUENT = 1 << 18


def ngram_sets(column, n: int, fold: bool):
    """For each text of a batch: its sorted distinct n-gram hashes."""
    for i, j, counts, words in C.batch_words(column, fold):
        ends = np.cumsum(counts)
        sums = C.prefix_sums(words)
        for lo, hi in zip((ends - counts).tolist(), ends.tolist()):
            if hi - lo == 0:
                yield np.empty(0, np.uint64)
                continue
            at = np.arange(lo, max(lo + 1, hi - n + 1))
            yield np.unique(C.range_hash(sums, at, np.minimum(at + n, hi)))


def max_difference(a: int, b: int, percent: int) -> int:
    """Most n-grams in which sets of these sizes can differ and still link."""
    return int((a + b) * (100 - percent) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """How many of its first columns a set of n n-grams sends; 0 where only an equal set can link."""
    if max_difference(n, 100 * n // percent, percent) == 0:
        return 0
    return n - -(-percent * n // 100) + 1


def bitmap(grams: np.ndarray) -> bytes:
    """Parity of the n-grams that fall on each of at least 64, and at least n, bits (a power of two)."""
    bits = 1 << max(6, int(len(grams) - 1).bit_length())
    odd = np.bincount((C.mix(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """No sets with these bitmaps differ in fewer n-grams."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n = min(len(a), len(b))
    return (_folded(x, len(a), n) ^ _folded(y, len(b), n)).bit_count()


def _folded(x: int, size: int, to: int) -> int:
    while size > to:
        size //= 2
        x = (x >> 8 * size) ^ (x & (1 << 8 * size) - 1)
    return x


def _node(grams: np.ndarray) -> int | None:
    return int((C.mix(grams).sum(dtype=np.uint64) ^ np.uint64(len(grams))).view(np.int64)) if len(grams) else None


def _signatures(n: int, percent: int, fold: bool, frequent):
    """mapInArrow body: (doc_id, k1, k2, text) -> the row without text, its set's size, key, bitmap and first columns."""
    def body(batches):
        gram, count = frequent.value
        for batch in batches:
            size, node, bits, cols, at = [], [], [], [], [0]
            for grams in ngram_sets(batch["text"], n, fold):
                size.append(len(grams))
                node.append(_node(grams))
                first = prefix_length(len(grams), percent) if len(grams) else 0
                bits.append(bitmap(grams) if first else None)
                if first:
                    weight = np.zeros(len(grams), np.int64)
                    if len(gram):
                        i = np.minimum(np.searchsorted(gram, grams), len(gram) - 1)
                        weight = np.where(gram[i] == grams, count[i], 0)
                    cols.append(grams[np.lexsort((C.mix(grams), weight))[:first]].view(np.int64))
                at.append(at[-1] + first)
            flat = np.concatenate(cols) if cols else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["k1"], batch["k2"], pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                names=["doc_id", "k1", "k2", "n_shingles", "node", "bits", "columns"])

    return body


def _gram_counts(n: int, fold: bool):
    """mapInArrow body: text -> (gram, number of texts of the batch that hold it)."""
    def body(batches):
        for batch in batches:
            grams = list(ngram_sets(batch["text"], n, fold))
            if grams:
                gram, count = np.unique(np.concatenate(grams), return_counts=True)
                for i in range(0, len(gram), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(gram[i:i + 100_000].view(np.int64)), pa.array(count[i:i + 100_000])],
                                                     names=["gram", "c"])

    return body


def _sets(n: int, fold: bool):
    """mapInArrow body: (node, text) -> the n-gram set as bytes."""
    def body(batches):
        for batch in batches:
            grams = [g.tobytes() for g in ngram_sets(batch["text"], n, fold)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(grams, pa.binary())], names=["node", "grams"])

    return body


def _close_bitmaps(percent: int):
    """mapInArrow body: pairs with bitmaps -> the pairs whose bitmaps allow a link."""
    def body(batches):
        for batch in batches:
            keep = [fewest_differences(x, y) <= max_difference(i, j, percent) for x, y, i, j in
                    zip(*(batch[c].to_pylist() for c in ("bits_a", "bits_b", "na", "nb")))]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return body


def overlap_counts(row: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """|row & x| for the sets of a tile: a sparse product over the columns of ``row``."""
    sizes = np.array([len(x) for x in others], np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(row, flat), len(row) - 1)
    shared = np.concatenate([[0], np.cumsum(row[at] == flat)])
    ends = np.cumsum(sizes)
    return shared[ends] - shared[ends - sizes]


def _tile(percent: int):
    """applyInArrow body: the set of row a and those of a block of rows -> (a, b, both, total) of the links."""
    def body(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node = table["node"].to_numpy()
        grams = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        own, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(own) or not len(rest):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        row = grams[own[0]]
        both = overlap_counts(row, [grams[i] for i in rest])
        union = len(row) + np.array([len(grams[i]) for i in rest]) - both
        link = 100 * both >= percent * union
        return pa.table({"a": pa.array(np.full(int(link.sum()), node[own[0]])), "b": pa.array(node[rest][link]),
                         "distance": pa.array((1 - both / union)[link])})

    return body


def _close_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_close_bitmaps(percent), "a long, b long")


def _verified(near: DataFrame, texts, percent: int, stages: Stages, name: str, fold: bool, n: int) -> DataFrame:
    """(a, b, distance) of the distinct pairs (a, b) that link, by tiles of whole sets."""
    place = F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1
    near = stages.put(f"{name}-near", near.select("a", "b", F.floor(place / TILE).alias("tile")))
    needed = stages.put(f"{name}-needed", near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = stages.put(f"{name}-sets", texts(needed).mapInArrow(_sets(n, fold), "node long, grams binary"))
    own = near.select("a", "tile").distinct().select("a", "tile", F.lit(0).alias("side"), F.col("a").alias("node"))
    rows = own.unionByName(near.select("a", "tile", F.lit(1).alias("side"), F.col("b").alias("node"))).join(sets, "node")
    found = stages.put(name, rows.groupBy("a", "tile").applyInArrow(_tile(percent), "a long, b long, distance double"))
    for key in ("near", "needed", "sets"):
        stages.drop(f"{name}-{key}")
    return found


def _cells(sigs: DataFrame, percent: int) -> DataFrame:
    """(key, node, n): the columns, each cut by size where no pair links across; rows without a partner in size are left out.

    Where the first n-gram that two sets share has p earlier ones in a set of
    n, they share at most n - p, so the other set has at most ``most`` n-grams.
    Copies of a set come next to each other and count once.
    """
    held = sigs.select(F.posexplode("columns").alias("pos", "key"), "node", F.col("n_shingles").alias("n"))
    held = held.select("key", "node", "n", F.floor(100 * (F.col("n") - F.col("pos")) / F.lit(float(percent)) - F.col("pos") + 1e-6).alias("most"))
    by_size = Window.partitionBy("key").orderBy("n", "node")
    seen = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    near = held.select("key", "node", "n", F.lag("node").over(by_size).alias("last"), F.lead("n").over(by_size).alias("next"),
                       F.max("most").over(seen).alias("reach"), F.max("most").over(before).alias("reached"))
    opens = F.expr("reached is null or n > reached")
    kept = near.where(~(opens & F.expr("next is null or next > reach")) & F.expr("last is null or last <> node"))
    cut = kept.select("key", "node", "n", opens.cast("long").alias("opens")).withColumn("cut", F.sum("opens").over(seen))
    return cut.select(F.xxhash64("key", "cut").alias("key"), "node", "n")


def _sizes_allow(percent: int):
    return F.expr(f"100 * least(na, nb) >= {int(percent)} * greatest(na, nb)")


def _links(cell: DataFrame, nodes: DataFrame, texts, percent: int, stages: Stages, row_block: int, pivots: int, fold: bool, n: int) -> DataFrame:
    """Links (a, b) whose components are those of all links among the nodes; cell(key, node, n) is a stored table."""
    verified = lambda near, name: _verified(near, texts, percent, stages, name, fold, n).select("a", "b")
    shared = cell.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    # columns held by the same rows are one
    one = stages.put("one", shared.where("c > 1").groupBy("c", "h").agg(F.min("key").alias("key")).select("key", "c"))
    cell = stages.put("once", cell.join(one, "key"))
    short = cell.where(F.col("c") <= row_block)
    members = short.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))  # at most row_block
    pairs = members.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> "
                                            "struct(x.node as a, y.node as b, x.n as na, y.n as nb))))")).alias("p")).select("p.*")
    # longer columns: pivots of each size class; the class ratio is the threshold
    size_class = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) if percent < 100 else F.col("n"))
    long_ = stages.put("long", cell.where(F.col("c") > row_block).withColumn("cls", size_class))
    first = Window.partitionBy("key", "cls").orderBy("node")
    pivot = stages.put("pivots", long_.withColumn("r", F.row_number().over(first)).where(F.col("r") <= pivots)
                       .select("key", "cls", F.col("node").alias("a"), F.col("n").alias("na")))
    star = long_.join(pivot, ["key", "cls"]).select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).where("a <> b")
    ordered = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                          F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb"))
    pairs = pairs.unionByName(ordered).where(_sizes_allow(percent)).select("a", "b").distinct()
    links = verified(_close_pairs(pairs, nodes, percent), "links1")
    if not long_.limit(1).count():
        return links

    # rows outside the main component of a long column, against all its rows of other components
    for turn, most in ((1, NEAREST), (2, None)):
        near = _outside(long_, nodes, components(links, stages, f"round{turn}"), percent, stages, most)
        links = links.unionByName(verified(near.distinct(), f"links{turn + 1}"))
    for key in ("one", "once", "long", "pivots", "placed", "open"):
        stages.drop(key)
    return links


def _outside(long_: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, stages: Stages, most: int | None) -> DataFrame:
    """Close pairs (a, b) of each column's rows outside its main component with its rows of other components, ``most`` a row and block if given."""
    placed = stages.put("placed", long_.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("part")))
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "part")).getField("part").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    before = Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)  # the columns of one set
    open_ = stages.put("open", placed.join(main.select("key", "main"), "key").withColumn("earlier", F.collect_list("key").over(before))
                       .join(nodes.select("node", "bits"), "node"))
    blocks = open_.groupBy("key").agg(F.expr(f"count_if(part <> main) div {BLOCK} + 1").alias("ni"), F.expr(f"count(*) div {BLOCK} + 1").alias("nj"))
    dealt = open_.join(blocks, "key").select("*", F.xxhash64("node").alias("h"))
    row = ["node", "n", "part", "bits", "earlier", F.expr("part = main").alias("inside")]
    rest = dealt.where("part <> main").select("key", F.expr("pmod(h, ni)").alias("i"), F.explode(F.expr("sequence(0, nj - 1)")).alias("j"), F.lit(0).alias("side"), *row)
    every = dealt.select("key", F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), F.expr("pmod(h, nj)").alias("j"), F.lit(1).alias("side"), *row)
    return rest.unionByName(every).groupBy("key", "i", "j").applyInArrow(_close_blocks(percent, most), "a long, b long")


def _bit_rows(bits: list[bytes], to: int) -> np.ndarray:
    """Bitmaps of one length as rows of ``to`` bytes."""
    x = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    while x.shape[1] > to:
        x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
    return x


def _close_blocks(percent: int, most: int | None = None):
    """applyInArrow body: rows of a block outside the main component (side 0) against a block of all rows (side 1) -> close pairs.

    ``most``: only so many pairs of a row of side 0, those with the closest bitmaps.
    """
    def body(table: pa.Table) -> pa.Table:
        side, node, size, part = (table[c].to_numpy() for c in ("side", "node", "n", "part"))
        inside = table["inside"].to_numpy()
        bits = table["bits"].to_pylist()
        earlier = [frozenset(x) for x in table["earlier"].to_pylist()]
        width = np.array([len(x) for x in bits])
        found = [np.empty((0, 3), np.int64)]
        for wa in np.unique(width[side == 0]):
            for wb in np.unique(width[side == 1]):
                a, b = np.flatnonzero((side == 0) & (width == wa)), np.flatnonzero((side == 1) & (width == wb))
                to = min(wa, wb)
                right = _bit_rows([bits[i] for i in b], to)
                for i, left in zip(a, _bit_rows([bits[i] for i in a], to)):
                    both = size[i] + size[b]
                    apart = np.bitwise_count(right ^ left).sum(axis=1, dtype=np.int64)
                    close = (apart <= both * (100 - percent) // (100 + percent)) & (part[b] != part[i]) & (inside[b] | (node[i] < node[b]))
                    close &= 100 * np.minimum(size[b], size[i]) >= percent * np.maximum(size[b], size[i])
                    first = [j for j in b[close].tolist() if earlier[i].isdisjoint(earlier[j])]  # an earlier column gives the others
                    if first:
                        gap = apart[np.searchsorted(b, first)]
                        found.append(np.column_stack([np.full(len(first), i), first, gap * 1_000_000 // both[np.searchsorted(b, first)]]))
        i, j, gap = np.concatenate(found).T
        if most is not None and len(i):
            order = np.lexsort((node[j], gap, i))
            i, j = i[order], j[order]
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            near = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < most
            i, j = i[near], j[near]
        return pa.table({"a": pa.array(np.minimum(node[i], node[j])), "b": pa.array(np.maximum(node[i], node[j]))})

    return body


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
                       percent: int = PERCENT, fold: bool = True, row_block: int = ROW_BLOCK,
                       pivots: int = PIVOTS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and its text key (k1, k2).

    Two documents link when 100 * intersection >= percent * union of their
    sets of n-word shingles; a text of fewer words has its whole sequence as
    one shingle; an empty or null text has none, links with nothing and is
    its own component.  component_id is the smallest doc_id reachable by
    links (null ids count as largest); repeated rows have equal sets.  Where
    ids are null or repeat, components may share a component_id.
    """
    stages = Stages(session(docs), "jaccard")
    return _rooted(docs, id_col, text_col, n, percent, stages, fold, row_block, pivots).drop("root")


def _rooted(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, stages: Stages, fold: bool = True,
            row_block: int = ROW_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """The rows of ``jaccard_components`` with ``root``, the set node that names the component (null without words)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    spark = session(docs)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("text")).select("doc_id", *C.text_key(F.col("text")), "text")

    sample = rows.where(F.pmod("k1", F.lit(SAMPLE)) == 0).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    counts = sample.select("text").mapInArrow(_gram_counts(n, fold), "gram long, c long")
    top = (counts.groupBy("gram").agg(F.sum("c").alias("c")).where("c > 2")
           .orderBy(F.col("c").desc(), "gram").limit(FREQUENT).collect())
    gram = np.array([r["gram"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(gram)
    frequent = spark.sparkContext.broadcast((gram[order], np.array([r["c"] for r in top], np.int64)[order]))
    sigs = stages.put("signatures", rows.mapInArrow(
        _signatures(n, percent, fold, frequent),
        f"doc_id {id_type}, k1 long, k2 long, n_shingles long, node long, bits binary, columns array<long>"))

    cell = stages.put("cells", _cells(sigs, percent))
    partners = cell.select("node").distinct()
    nodes = stages.put("nodes", sigs.join(partners, "node", "left_semi").groupBy("node").agg(
        F.min("n_shingles").alias("n"), F.min("bits").alias("bits")))

    def texts(needed: DataFrame) -> DataFrame:
        """(node, text) for the nodes of a stored table, each from one text."""
        chosen = stages.put("chosen", sigs.join(needed, "node", "left_semi").groupBy("node")
                            .agg(F.min(F.struct("k1", "k2")).alias("k")).select("node", "k.*"))
        return C.texts_of(docs, text_col, chosen.select("k1", "k2")).join(chosen, ["k1", "k2"]).select("node", "text")

    links = _links(cell, nodes, texts, percent, stages, row_block, pivots, fold, n)
    linked = stages.put("linked", components(links, stages, "linked"))

    # equal sets are one node
    first = sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = first.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    named = stages.put("named", named)
    smallest = stages.put("smallest", named.groupBy("root").agg(F.min("first").alias("component_id")))
    where = stages.put("where", named.join(smallest, "root").select("node", "root", "component_id"))
    for key in ("chosen", "cells", "nodes", "links1", "links2", "links3", "linked", "named", "smallest"):
        stages.drop(key)
    return (sigs.select("doc_id", "n_shingles", "node", "k1", "k2").join(where, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root", "k1", "k2"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
             percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each linked group: that with the smallest id.

    Documents without words are groups of their own.  Rows that share an id
    and a group (repeated rows) keep one, the smallest text key first.
    """
    stages = Stages(session(docs), "keep-one")
    found = stages.put("found", _rooted(docs, id_col, text_col, n, percent, stages))
    stages.drop("signatures")
    stages.drop("where")
    grouped = found.where("n_shingles > 0").groupBy("root")  # an id may be null or in several components
    best = stages.put("best", grouped.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("m"))
                      .select("m.doc_id", "m.k1", "m.k2"))
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).alias("id"), *C.text_key(t), F.rlike(t, F.lit(r"[^\x20\x09-\x0D]")).alias("words"))
    same = rows["id"].eqNullSafe(best["doc_id"]) & (rows["k1"] == best["k1"]) & (rows["k2"] == best["k2"])
    kept = rows.where("words").join(best, same, "left_semi").select("row", "id", "k1", "k2")
    # rows that repeat id and text: one of them
    twice = stages.put("twice", kept.groupBy("id", "k1", "k2").agg(F.count("*").alias("c")).where("c > 1"))
    one = kept.join(twice.drop("c"), (kept["id"].eqNullSafe(twice["id"])) & (kept["k1"] == twice["k1"]) & (kept["k2"] == twice["k2"]), "left_anti").select("row")
    more = (kept.join(twice.drop("c"), (kept["id"].eqNullSafe(twice["id"])) & (kept["k1"] == twice["k1"]) & (kept["k2"] == twice["k2"]), "left_semi")
            .groupBy("id", "k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return one.union(more).union(rows.where("not words").select("row")).select("row.*")
