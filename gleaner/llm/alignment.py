"""Alignment of the tokens that two tokenizers cut from the same text.

Both tokenizers cover the bytes of space + text.  Offsets where a token of A
and a token of B both end cut the tokens into groups; tokens of a group whose
byte ranges overlap are linked.  The end offsets of both sides, merged, give
one link for each stretch between neighbouring offsets, so links are found
without pairing the tokens of a group.

* Identity map: an array that gives, for every A id, the B id of the same
  bytes.  Exact one-to-one groups, and any other link of an id with its
  identity, are counted in vectors as long as A's vocabulary, one a task.
* Only the other links enter the pair shuffle, and not document by document:
  texts are dealt to blocks of bounded size, a block sends each of its
  distinct pairs once with its number of documents, and the totals come back
  to the blocks, where the documents look them up.
* Totals of identity pairs and the largest total of every A id are arrays of
  A's vocabulary length; nothing that grows with the data is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.bpe import _byte_of_char
from gleaner.llm.common import Stages, session

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
#: A pair in more than 1 / HEAVY of the block rows is looked up by broadcast; there are fewer than HEAVY such.
HEAVY = 50_000
_FIELDS = ["n_a", "n_b", "n_groups", "n_links"]


# --------------------------------------------------------------- tokenizers
class ByteLevel:
    """Byte-level BPE of a tokenizers JSON file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.tokens = [b""] * (max([*ranks.values(), *(t["id"] for t in spec.get("added_tokens", ()))]) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.fast = tiktoken.Encoding("from_json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = Tokenizer.from_file(path)
        self.known.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self.fast.encode_ordinary(t) for t in texts]
        probe = min(range(len(texts)), key=lambda i: len(texts[i]), default=None)
        if probe is not None and out[probe] != self.known.encode(texts[probe], add_special_tokens=False).ids:
            raise ValueError("the fast encoder's ids differ from the tokenizer file's")
        return out


class Pieces:
    """A sentencepiece model; U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.tokens.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.tokens.append(piece.replace("▁", " ").encode())
        self.plain = [not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
                      for i in range(len(self.tokens))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers of a worker, token lengths, printed ids and the identity map."""

    def __init__(self, name_a: str, name_b: str):
        import public_tokenizers

        self.a = ByteLevel(public_tokenizers.path(name_a))
        self.b = Pieces(public_tokenizers.path(name_b))
        self.len_a = np.array([len(t) for t in self.a.tokens], np.int64)
        self.len_b = np.array([len(t) for t in self.b.tokens], np.int64)
        self.identity = identity_map(self.a.tokens, self.b.tokens, self.b.plain)
        self.width = len(str(max(len(self.len_a), len(self.len_b)) - 1))
        size = max(len(self.len_a), len(self.len_b))
        shown = np.array([str(i).rjust(self.width) for i in range(size)], f"S{self.width}")
        self.shown = shown.view(np.uint8).reshape(size, self.width)


def identity_map(a: list[bytes], b: list[bytes], plain: list[bool]) -> np.ndarray:
    """For every A id the B id of the same bytes (a plain piece before a byte piece), else -1."""
    at: dict[bytes, int] = {}
    for i in sorted(range(len(b)), key=lambda i: (not plain[i], i)):
        if b[i]:
            at.setdefault(b[i], i)
    return np.array([at.get(t, -1) if t else -1 for t in a], np.int64)


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(name_a: str, name_b: str) -> Pair:
    if (name_a, name_b) not in _pairs:
        _pairs[name_a, name_b] = Pair(name_a, name_b)
    return _pairs[name_a, name_b]


# ---------------------------------------------------------------- alignment
class Aligned:
    """The groups and links of several texts, one after the other."""

    def __init__(self, pair: Pair, ids_a: list[list[int]], ids_b: list[list[int]]):
        count = lambda ids: np.array([len(x) for x in ids], np.int64)
        flat = lambda ids: np.fromiter((t for x in ids for t in x), np.int64, sum(map(len, ids)))
        self.pair, self.n_a, self.n_b = pair, count(ids_a), count(ids_b)
        self.a, self.b = flat(ids_a), flat(ids_b)
        end_a, end_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        ends = np.union1d(end_a, end_b)
        at = np.searchsorted(end_a, ends)
        self.link_a, self.link_b = self.a[at], self.b[np.searchsorted(end_b, ends)]
        self.link_doc = np.repeat(np.arange(len(ids_a)), self.n_a)[at]
        # texts end at a shared offset, so each group belongs to one text
        last = np.cumsum(self.n_a)
        upto = np.concatenate([[0], self.group_a + 1])[last] if len(last) else last
        self.n_groups = np.diff(np.concatenate([[0], upto]))
        self.n_links = np.bincount(self.link_doc, minlength=len(ids_a))

    def digests(self) -> list[str]:
        """SHA-256 of every text's groups as ``a,a|b;a|b,b``."""
        w = self.pair.width
        n = len(self.a) + len(self.b)
        at_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        at_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        cells = np.empty((n, w + 1), np.uint8)
        cells[at_a, :w], cells[at_b, :w] = self.pair.shown[self.a], self.pair.shown[self.b]
        final = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool)
        cells[at_a, w] = np.where(final(self.group_a), ord("|"), ord(","))
        cells[at_b, w] = np.where(final(self.group_b), ord(";"), ord(","))
        used = cells != ord(" ")
        ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        text = cells[used].tobytes()
        return [hashlib.sha256(text[i:max(i, j - 1)]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def align_texts(pair: Pair, texts: list[str | None]) -> Aligned:
    """Texts that are null, empty or not covered byte for byte by both tokenizers get no tokens."""
    spaced = [" " + t if t else "" for t in texts]
    ids_a = pair.a.encode(spaced)
    ids_b = pair.b.encode([t or "" for t in texts])
    for i, t in enumerate(spaced):
        raw = t.encode()
        if not t or b"".join([pair.a.tokens[x] for x in ids_a[i]]) != raw or b"".join([pair.b.tokens[x] for x in ids_b[i]]) != raw:
            ids_a[i], ids_b[i] = [], []
    return Aligned(pair, ids_a, ids_b)


def _grouped(doc: np.ndarray, key: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) with how often each occurs."""
    both, n = np.unique(doc * span + key, return_counts=True)
    return both // span, both % span, n


class _Block:
    """Links of the texts of one block that are not identities."""

    def __init__(self):
        self.size, self.rows, self.doc, self.key, self.n = 0, 0, [], [], []

    def add(self, doc, key, n, rows: int, size: int):
        self.doc.append(doc + self.rows)
        self.key.append(key)
        self.n.append(n)
        self.rows += rows
        self.size += size

    def arrays(self):
        doc, key, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.doc, self.key, self.n))
        keys, at, docs = np.unique(key, return_inverse=True, return_counts=True)
        return keys, docs, doc, at, n


_ENCODED = ("kind int, block long, pos int, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "ids array<int>, times array<int>, keys array<long>, docs array<long>")


def _encode(name_a: str, name_b: str, block_bytes: int):
    """mapInArrow body: (doc_id, text) -> rows of three kinds.

    0: a document, with the A ids of its identity links and how often each
    occurs; 1: a block, with its distinct other pairs (``keys``), the number
    of its documents that hold each (``docs``) and, for each (document, pair),
    the document's position (``ids``), the pair's index and the number of
    links (both in ``times``, one after the other); 2: the identity vector of
    the task (``ids``, ``docs``).
    """
    def body(batches):
        from pyspark import TaskContext

        pair = tokenizers(name_a, name_b)
        span = len(pair.len_b)
        vector = np.zeros(len(pair.len_a), np.int64)
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        id_type = None

        def row(kind, block_no, **lists):
            cols = {"ids": pa.int32(), "times": pa.int32(), "keys": pa.int64(), "docs": pa.int64()}
            one = [pa.array([kind], pa.int32()), pa.array([block_no], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, id_type),
                   *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
            for c, t in cols.items():
                x = lists.get(c)
                one.append(pa.nulls(1, pa.list_(t)) if x is None else
                           pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)))
            return pa.RecordBatch.from_arrays(one, names=_names())

        def close():
            nonlocal block, number
            keys, docs, doc, at, n = block.arrays()
            out = row(1, number, keys=keys, docs=docs, ids=doc, times=np.concatenate([at, n])) if len(keys) else None
            block, number = _Block(), number + 1
            return out

        for batch in batches:
            id_type = batch["doc_id"].type
            _, offsets = C.text_buffer(batch["text"])
            for i, j in C.runs_of_texts(offsets):
                size = int(offsets[j] - offsets[i])
                if block.rows and block.size + size > block_bytes:
                    done = close()
                    if done is not None:
                        yield done
                got = align_texts(pair, batch["text"].slice(i, j - i).to_pylist())
                exact = pair.identity[got.link_a] == got.link_b
                doc, ids, times = _grouped(got.link_doc[exact], got.link_a[exact], len(vector))
                vector += np.bincount(ids, minlength=len(vector))
                first = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(j - i, np.int32)), pa.array(np.full(j - i, number)),
                     pa.array(np.arange(block.rows, block.rows + j - i, dtype=np.int32)), batch["doc_id"].slice(i, j - i),
                     *[pa.array(getattr(got, f).astype(np.int64)) for f in _FIELDS], pa.array(got.digests(), pa.string()),
                     pa.ListArray.from_arrays(pa.array(first), pa.array(ids.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(first), pa.array(times.astype(np.int32))),
                     pa.nulls(j - i, pa.list_(pa.int64())), pa.nulls(j - i, pa.list_(pa.int64()))], names=_names())
                other = ~exact
                block.add(*_grouped(got.link_doc[other], got.link_a[other] * span + got.link_b[other], len(vector) * span),
                          rows=j - i, size=size)
        if block.rows:
            done = close()
            if done is not None:
                yield done
        held = np.flatnonzero(vector)
        if len(held):
            yield row(2, -1, ids=held, docs=vector[held])

    return body


def _names() -> list[str]:
    return ["kind", "block", "pos", "doc_id", *_FIELDS, "groups_sha256", "ids", "times", "keys", "docs"]


def _identity_sums(totals, best):
    """mapInArrow body over documents: the share of identity links in n_best and count_sum."""
    def body(batches):
        total, top = totals.value, best.value
        for batch in batches:
            at = batch["ids"].offsets.to_numpy().astype(np.int64)
            lo, hi = int(at[0]), int(at[-1])
            ids = batch["ids"].values.to_numpy(zero_copy_only=False)[lo:hi]
            times = batch["times"].values.to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)
            run = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at - lo])
            keep = [c for c in batch.schema.names if c not in ("ids", "times")]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in keep], pa.array(run(times * (total[ids] == top[ids]))), pa.array(run(times * total[ids]))],
                names=[*keep, "best0", "sum0"])

    return body


def _block_sums(best, span: int):
    """cogroup body: a block's links and the totals of its pairs -> (block, pos, best1, sum1)."""
    def body(links: pa.Table, totals: pa.Table) -> pa.Table:
        top = best.value
        out: dict[str, list] = {"block": [], "pos": [], "best1": [], "sum1": []}
        total_of = dict(zip(totals["key"].to_pylist(), totals["total"].to_pylist()))
        for b in range(links.num_rows):
            keys = np.array(links["keys"][b].values.to_numpy(zero_copy_only=False))
            doc = links["ids"][b].values.to_numpy(zero_copy_only=False)
            at, times = np.split(links["times"][b].values.to_numpy(zero_copy_only=False).astype(np.int64), 2)
            total = np.array([total_of[k] for k in keys.tolist()], np.int64)
            is_best = total == top[keys // span]
            pos, where = np.unique(doc, return_inverse=True)
            sums = np.zeros((2, len(pos)), np.int64)
            np.add.at(sums[0], where, times * is_best[at])
            np.add.at(sums[1], where, times * total[at])
            out["block"].append(np.full(len(pos), links["block"][b].as_py()))
            out["pos"].append(pos)
            out["best1"].append(sums[0])
            out["sum1"].append(sums[1])
        flat = {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}
        return pa.table({"block": pa.array(flat["block"], pa.int64()), "pos": pa.array(flat["pos"].astype(np.int32)),
                         "best1": pa.array(flat["best1"], pa.int64()), "sum1": pa.array(flat["sum1"], pa.int64())})

    return body


def token_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_a: str = TOKENIZER_A,
                    name_b: str = TOKENIZER_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The count of an id pair is the number of documents that hold it linked;
    n_best counts the links whose count is the highest of their A id
    anywhere, count_sum sums the counts over the links.  Null, empty and not
    coverable texts have zeros and an empty digest.  Ids may be null or
    repeat (each row is a document); other columns are ignored.  An empty
    table gives an empty result.
    """
    spark = session(docs)
    stages = Stages(spark, "alignment")
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = stages.put("encoded", rows.mapInArrow(_encode(name_a, name_b, block_bytes), _ENCODED.format(id=id_type)))
    pair = tokenizers(name_a, name_b)
    span = len(pair.len_b)

    blocks = encoded.where("kind = 1")
    held = blocks.select("block", F.explode(F.arrays_zip("keys", "docs")).alias("z")).select("block", "z.keys", "z.docs")
    totals = stages.put("totals", held.groupBy(F.col("keys").alias("key")).agg(F.sum("docs").alias("total"), F.count("*").alias("in_blocks")))
    # as many numbers as A has ids
    identity, best = np.zeros(len(pair.len_a), np.int64), np.zeros(len(pair.len_a), np.int64)
    vectors = encoded.where("kind = 2").select(F.explode(F.arrays_zip("ids", "docs")).alias("z")).groupBy("z.ids").agg(F.sum("z.docs").alias("n"))
    for r in vectors.collect():
        identity[r["ids"]] = r["n"]
    for r in totals.groupBy(F.expr(f"key div {span}").alias("a")).agg(F.max("total").alias("n")).collect():
        best[r["a"]] = r["n"]
    best = np.maximum(best, identity)
    shared_identity, shared_best = spark.sparkContext.broadcast(identity), spark.sparkContext.broadcast(best)

    # totals back to the blocks: pairs of many blocks by broadcast (fewer than HEAVY), the rest by key
    limit = (totals.agg(F.sum("in_blocks")).first()[0] or 0) // HEAVY + 1
    wanted = held.select(F.col("block").alias("of"), F.col("keys").alias("key"))
    heavy = totals.where(F.col("in_blocks") > limit).select("key", "total")
    light = totals.where(F.col("in_blocks") <= limit).select("key", "total")
    back = wanted.join(F.broadcast(heavy), "key").unionByName(wanted.join(light, "key"))
    links = blocks.select("block", "ids", "times", "keys")
    sums = links.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(
        _block_sums(shared_best, span), "block long, pos int, best1 long, sum1 long")

    narrow = ["doc_id", "block", "pos", *_FIELDS, "groups_sha256"]
    own = encoded.where("kind = 0").select(*narrow, "ids", "times").mapInArrow(
        _identity_sums(shared_identity, shared_best),
        f"doc_id {id_type}, block long, pos int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best0 long, sum0 long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.join(sums, ["block", "pos"], "left").select(
        "doc_id", *_FIELDS, (F.col("best0") + zero("best1")).alias("n_best"), (F.col("sum0") + zero("sum1")).alias("count_sum"), "groups_sha256")
