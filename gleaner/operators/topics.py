"""Topic responses -> topic table, and topic-table maintenance.

Responses arrive as a table ``(doc_pos, response)`` (the generation calls
themselves are outside this library).  Everything that the reference does
one document at a time is relational here:

* a topic is created by its first valid mention (case-insensitive name at
  level 1); later mentions add 1 - a grouped aggregate;
* early stop: the run of consecutive duplicate mentions after the k-th
  new topic (first seen at dense mention index p_k) reaches ``n + 1`` when
  ``p_{k+1} > p_k + n + 1``; the stop index is the smallest such
  ``p_k + n + 1``.  Only the first-seen positions (one row per topic) are
  ordered, never the mentions;
* topic trees are adjacency tables ``(node_id, lvl, name, count, desc,
  parent_id)`` with ``node_id`` = line number of the creating line and
  ``parent_id`` 0 for the root; a materialised ``path`` gives pre-order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.stopwords import TOPIC_FILLER
from gleaner.operators.ordered import with_last_seen, with_next
from gleaner.operators.reviews import assign_row_id, normalize_strip
from gleaner.session import checkpoint_dir

_WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}"
# FIXED VALUES: line formats of generated topics, topic files and seed files.
MENTION_RE = r"(?sU)^\[([0-9]+)\] ([\w" + _WS + r"]+):(.+)"
TOPIC_LINE_RE = r"(?sU)^\[([0-9]+)\] (.+) \(Count: ([0-9]+)\)[" + _WS + r"]?:(.+)?"
SEED_LINE_RE = r"(?sU)^\[([0-9]+)\] (.+)"
DESC_WORD_RE = r"[a-zA-Z']+"


# ---------------------------------------------------------------- responses
def explode_responses(responses: DataFrame, doc_col: str = "doc_pos", resp_col: str = "response") -> DataFrame:
    """``(doc_pos, line_pos, line)``: each response split on newlines, stripped."""
    return (responses.select(doc_col, F.posexplode(F.split(F.col(resp_col), "\n")).alias("line_pos", "_l"))
                     .select(doc_col, "line_pos", normalize_strip("_l").alias("line")))


def parse_topic_mentions(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``lvl, name, desc, status``; status is ``ok``, ``invalid_format``
    or ``lower_level`` (only level-1 mentions are accepted)."""
    lvl = F.regexp_extract(line_col, MENTION_RE, 1).try_cast("int")  # null beyond the range of a level
    ok = F.col(line_col).rlike(MENTION_RE) & lvl.isNotNull()
    status = (F.when(~ok, F.lit("invalid_format"))
               .when(lvl != 1, F.lit("lower_level")).otherwise(F.lit("ok")))
    return lines.select(
        "*", F.when(ok, lvl).alias("lvl"),
        F.when(ok, normalize_strip(F.regexp_extract(line_col, MENTION_RE, 2))).alias("name"),
        F.when(ok, normalize_strip(F.regexp_extract(line_col, MENTION_RE, 3))).alias("desc"),
        status.alias("status"))


def processed_limit(responses: DataFrame, doc_col: str = "doc_pos", resp_col: str = "response") -> DataFrame:
    """One row: ``first_error`` = doc position of the first failed call
    (response ``Error``), where the reference stops; NULL when none."""
    return responses.agg(F.min(F.when(F.col(resp_col) == "Error", F.col(doc_col))).alias("first_error"))


def _until_error(responses: DataFrame, doc_col: str, resp_col: str) -> DataFrame:
    lim = processed_limit(responses, doc_col, resp_col)
    return responses.crossJoin(F.broadcast(lim)).filter(  # one-row table
        F.col("first_error").isNull() | (F.col(doc_col) <= F.col("first_error"))).drop("first_error")


def valid_mentions(responses: DataFrame, doc_col: str = "doc_pos", resp_col: str = "response") -> DataFrame:
    """Accepted mentions ``(idx, doc_pos, line_pos, name, desc, key)`` with a
    dense 1-based index in document order, cut at the first failed call."""
    parsed = parse_topic_mentions(explode_responses(_until_error(responses, doc_col, resp_col), doc_col, resp_col))
    ok = parsed.filter(F.col("status") == "ok").select(doc_col, "line_pos", "lvl", "name", "desc")
    ordered = ok.orderBy(doc_col, "line_pos")
    with_idx = assign_row_id(ordered, "idx").withColumn("idx", F.col("idx") + 1)
    return with_idx.withColumn("key", F.lower("name"))


def _keyed_seeds(seeds: DataFrame) -> DataFrame:
    """Seed topics with their key; ``topic_order`` ends at 0, before the first mention."""
    last = seeds.agg(F.max("line_no").alias("_last"))
    return seeds.crossJoin(F.broadcast(last)).select(  # one-row table
        (F.col("line_no") - F.col("_last")).cast("long").alias("topic_order"), "lvl", "name", "count", "desc",
        F.lower("name").alias("key"))


def early_stop_index(mentions: DataFrame, n: int | None = 2000, doc_col: str = "doc_pos",
                     seeds: DataFrame | None = None) -> DataFrame:
    """One row ``(stop_idx, stop_doc)``: the mention at which generation stops
    (the (n+1)-th consecutive duplicate), or NULLs when it never stops.

    A mention of a topic of ``seeds`` is a duplicate from the start, so a run
    can begin before the first new topic (p_0 = 0).
    """
    if n is None:
        return mentions.agg(F.lit(None).cast("long").alias("stop_idx"), F.lit(None).cast("long").alias("stop_doc"))
    firsts = mentions.groupBy("lvl", "key").agg(F.min("idx").alias("p"))
    if seeds is not None:
        firsts = firsts.join(_keyed_seeds(seeds).select("lvl", "key"), ["lvl", "key"], "left_anti")
    start = mentions.sparkSession.range(1).select(F.lit(0).cast("long").alias("p"))
    total = mentions.agg(F.max("idx").alias("_total"))
    # one row per distinct topic: the order runs over topics, not mentions
    gaps = (with_next(firsts.select("p").unionByName(start), "p", "next_p").crossJoin(F.broadcast(total))  # one-row table
                  .withColumn("next_p", F.coalesce("next_p", F.col("_total") + 1))
                  .filter(F.col("next_p") > F.col("p") + n + 1))
    stop = gaps.agg(F.min(F.col("p") + n + 1).alias("idx"))
    # one row looks up its mention; the aggregate restores the NULL row
    return (mentions.select("idx", F.col(doc_col).alias("_doc")).join(F.broadcast(stop), "idx")
                    .agg(F.min("idx").alias("stop_idx"), F.min("_doc").alias("stop_doc")))


def fold_topics(mentions: DataFrame, early_stop: int | None = 2000, seeds: DataFrame | None = None,
                doc_col: str = "doc_pos") -> DataFrame:
    """Topic table ``(topic_order, lvl, name, count, desc)`` in first-seen order.

    The first mention's casing and description win; every later mention of
    the same lower-cased name adds 1.  Mentions after the early-stop index
    are not processed (the stopping mention itself is counted).  ``seeds``
    (see ``read_seed_topics``) come first, with orders up to 0; a mention adds
    1 to the first seed of its level and name.
    """
    stop = early_stop_index(mentions, early_stop, doc_col, seeds)
    kept = mentions.crossJoin(F.broadcast(stop.select("stop_idx"))).filter(  # one-row table
        F.col("stop_idx").isNull() | (F.col("idx") <= F.col("stop_idx")))
    folded = kept.groupBy("lvl", "key").agg(F.count(F.lit(1)).alias("count"), F.min("idx").alias("topic_order"))
    cols = ["topic_order", "lvl", "name", "count", "desc"]
    texts = mentions.select(F.col("idx").alias("topic_order"), "name", "desc")
    if seeds is None:
        return folded.join(texts, "topic_order").select(*cols)
    known = _keyed_seeds(seeds)
    first = known.groupBy("lvl", "key").agg(F.min("topic_order").alias("topic_order"))
    more = folded.drop("topic_order").join(first, ["lvl", "key"]).select("topic_order", F.col("count").alias("_more"))
    old = known.join(more, "topic_order", "left").withColumn("count", F.col("count") + F.coalesce("_more", F.lit(0)))
    new = folded.join(first.select("lvl", "key"), ["lvl", "key"], "left_anti").join(texts, "topic_order")
    return old.select(*cols).unionByName(new.select(*cols))


def processed_responses(responses: DataFrame, mentions: DataFrame, early_stop: int | None = 2000,
                        doc_col: str = "doc_pos", seeds: DataFrame | None = None) -> DataFrame:
    """Responses of the documents actually processed: up to the first failed
    call (inclusive) and before the document where early stop fired."""
    lim = processed_limit(responses, doc_col)
    stop = early_stop_index(mentions, early_stop, doc_col, seeds)
    both = lim.crossJoin(stop)  # one row x one row
    return (responses.crossJoin(F.broadcast(both))
                     .filter((F.col("first_error").isNull() | (F.col(doc_col) <= F.col("first_error")))
                             & (F.col("stop_doc").isNull() | (F.col(doc_col) < F.col("stop_doc"))))
                     .drop("first_error", "stop_idx", "stop_doc"))


def topic_rejects(responses: DataFrame, doc_col: str = "doc_pos", resp_col: str = "response") -> DataFrame:
    """Lines the parser skipped up to the first failed call, with the reason."""
    parsed = parse_topic_mentions(explode_responses(_until_error(responses, doc_col, resp_col), doc_col, resp_col))
    return parsed.filter(F.col("status") != "ok").select(doc_col, "line_pos", "line", "status")


# ------------------------------------------------------------- topic files
def parse_topic_lines(lines: DataFrame, line_col: str = "line", no_col: str = "line_no") -> DataFrame:
    """``[lvl] name (Count: n): desc`` -> ``(line_no, lvl, name, count, desc, status)``.

    Blank lines are dropped; unmatched lines get status ``reject`` (the
    reference silently reuses the previous line's values instead).
    """
    t = normalize_strip(line_col)
    base = lines.select(no_col, t.alias("_t")).filter(F.col("_t") != "")
    g = lambda i: F.regexp_extract("_t", TOPIC_LINE_RE, i)
    ok = F.col("_t").rlike(TOPIC_LINE_RE) & g(1).try_cast("int").isNotNull() & g(3).try_cast("long").isNotNull()
    return base.select(
        no_col, F.when(ok, g(1).try_cast("int")).alias("lvl"), F.when(ok, normalize_strip(g(2))).alias("name"),
        F.when(ok, g(3).try_cast("long")).alias("count"), F.when(ok, normalize_strip(g(4))).alias("desc"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("reject")).alias("status"))


def read_seed_topics(lines: DataFrame, line_col: str = "line", no_col: str = "line_no",
                     cut_at_colon: bool = True) -> DataFrame:
    """Seed topics ``[lvl] name: desc`` -> ``(line_no, lvl, name, count=1, desc='')``.

    ``cut_at_colon=False`` keeps the reference behaviour (the whole remainder
    is the name, so a seed never matches a generated topic of that name).
    """
    t = normalize_strip(line_col)
    lvl = F.regexp_extract("_t", SEED_LINE_RE, 1).try_cast("int")
    base = lines.select(no_col, t.alias("_t")).filter((F.col("_t") != "") & F.col("_t").rlike(SEED_LINE_RE) & lvl.isNotNull())
    name = F.regexp_extract("_t", SEED_LINE_RE, 2)
    if cut_at_colon:
        name = F.split(name, ":")[0]
    return base.select(no_col, lvl.alias("lvl"),
                       normalize_strip(name).alias("name"), F.lit(1).cast("long").alias("count"),
                       F.lit("").alias("desc"))


def topic_parents(parsed: DataFrame, max_level: int | None = None, no_col: str = "line_no") -> DataFrame:
    """Build the topic tree from parsed lines.

    Parent = the latest *created* node one level up before the line; a line
    whose level has no such node is dropped (orphan); a repeated name under
    the same parent adds its count to the first one.  Returns
    ``(node_id, lvl, name, count, desc, parent_id)``.  Levels are resolved one
    after another (tree depth is small); the last node seen is carried along
    ranges of lines.
    """
    lines = parsed.filter(F.col("status") == "ok").select(no_col, "lvl", "name", "count", "desc")
    if max_level is None:
        max_level = lines.agg(F.max("lvl")).first()[0] or 0
    created = None
    out = []
    for lvl in range(1, max_level + 1):
        cand = lines.filter(F.col("lvl") == lvl)
        if lvl == 1:
            cand = cand.withColumn("parent_id", F.lit(0).cast("long"))
        else:
            marks = created.select(F.col("node_id").alias(no_col), F.col("node_id").alias("_mark"))
            seq = cand.withColumn("_mark", F.lit(None).cast("long")).unionByName(
                marks, allowMissingColumns=True)
            cand = (with_last_seen(seq, [no_col, "_mark"], "_mark", "parent_id")
                       .filter(F.col("_mark").isNull() & F.col("lvl").isNotNull()).drop("_mark")
                       .filter(F.col("parent_id").isNotNull()))
        nodes = (cand.groupBy("parent_id", "name")
                     .agg(F.min(no_col).alias("_first"), F.sum("count").alias("count"),
                          F.min_by(F.col("desc"), F.col(no_col)).alias("desc"))
                     .select(F.col("_first").cast("long").alias("node_id"), F.lit(lvl).alias("lvl"), "name",
                             "count", "desc", "parent_id"))
        created = nodes
        out.append(nodes)
    if not out:
        return parsed.sparkSession.createDataFrame(
            [], "node_id long, lvl int, name string, count long, desc string, parent_id long")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def with_paths(tree: DataFrame, max_level: int | None = None) -> DataFrame:
    """Add ``path``: node ids from the level-1 ancestor down to the node.
    Sorting by ``path`` gives pre-order (siblings in creation order)."""
    if max_level is None:
        max_level = tree.agg(F.max("lvl")).first()[0] or 0
    cur = tree.filter(F.col("lvl") == 1).withColumn("path", F.array(F.col("node_id")))
    res = cur
    for lvl in range(2, max_level + 1):
        par = cur.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_pp"))
        cur = (tree.filter(F.col("lvl") == lvl).join(par, "parent_id")
                   .withColumn("path", F.concat("_pp", F.array(F.col("node_id")))).drop("_pp"))
        res = res.unionByName(cur)
    return res


def node_to_str(count: bool = True, desc: bool = True) -> F.Column:
    """The four string forms of a topic node."""
    head = F.format_string("[%d] %s", F.col("lvl"), F.col("name"))
    if count:
        head = F.concat(head, F.format_string(" (Count: %d)", F.col("count")))
    if desc:
        head = F.concat(head, F.lit(": "), F.col("desc"))
    return head


def topic_list(tree: DataFrame, desc: bool = True, count: bool = True) -> DataFrame:
    """``(path, topic)`` strings in pre-order."""
    return with_paths(tree).select("path", node_to_str(count, desc).alias("topic"))


def topic_file_lines(tree: DataFrame) -> DataFrame:
    """Lines of the topic file: only topics with a description, indented by
    four spaces per level below 1, pre-order."""
    t = with_paths(tree).filter(F.length("desc") > 0)
    return t.select("path", F.concat(F.repeat(F.lit("    "), F.col("lvl") - 1), node_to_str()).alias("line"))


def topic_outline(tree: DataFrame) -> DataFrame:
    """Tab-indented ``[lvl] name`` lines in pre-order (descriptions never shown)."""
    t = with_paths(tree)
    return t.select("path", F.concat(F.repeat(F.lit("\t"), F.col("lvl") - 1), node_to_str(False, False))
                    .alias("line"))


def topic_names(tree: DataFrame) -> DataFrame:
    return tree.select("name")


def find_duplicates(tree: DataFrame, sought: DataFrame) -> DataFrame:
    """``(sought, *tree columns)``: the nodes of the same level and, case aside, the same name.

    ``sought`` is ``(lvl, name)``; repeated rows count once, a null name or
    level finds nothing.  An equi-join, so a common name costs one row a node.
    """
    wanted = sought.select("lvl", F.col("name").alias("sought")).distinct().withColumn("_key", F.lower("sought"))
    return tree.withColumn("_key", F.lower("name")).join(wanted, ["lvl", "_key"]).select("sought", *tree.columns)


def remove_topic(tree: DataFrame, name: str, lvl: int) -> DataFrame:
    """Remove the first exact (name, lvl) match in pre-order, with its subtree."""
    t = with_paths(tree)
    victim = (t.filter((F.col("name") == name) & (F.col("lvl") == lvl))
               .agg(F.min_by("node_id", "path").alias("_victim")))
    return (t.crossJoin(F.broadcast(victim))  # one-row table
             .filter(F.col("_victim").isNull() | ~F.array_contains("path", F.col("_victim")))
             .drop("_victim", "path"))


def merge_topics(tree: DataFrame, originals: Sequence[tuple[str, int]], new_name: str, new_desc: str,
                 keep_existing_count: bool = True) -> DataFrame:
    """Merge the listed (name, lvl) topics into ``new_name``.

    Counts of every node matching a listed name (case-insensitive, at that
    level) are summed - a name listed twice counts twice, as in the
    reference.  The merged node sits under the first listed match's parent;
    if a node called ``new_name`` already exists there it is reused and, by
    default, keeps its own count too (``keep_existing_count=False`` gives the
    reference's overwrite).  Merged nodes are removed with their subtrees.  A
    new node gets the next free id, so merges can follow each other.
    """
    spark = tree.sparkSession
    mapping = spark.createDataFrame([(n.lower(), int(lv), i) for i, (n, lv) in enumerate(originals)],
                                    "key string, lvl int, ord int")
    checkpoint_dir(spark)
    t = with_paths(tree).checkpoint(eager=True)  # read six times below; as small as the topic file
    hits = t.withColumn("key", F.lower("name")).join(F.broadcast(mapping), ["key", "lvl"])
    agg = hits.agg(F.sum("count").alias("_total"),
                   F.min_by("parent_id", F.struct("ord", "path")).alias("_parent"),
                   F.min_by("lvl", F.struct("ord", "path")).alias("_lvl"))
    merged_ids = hits.select("node_id").distinct()
    existing = (t.crossJoin(F.broadcast(agg))  # one-row table
                 .filter((F.col("parent_id") == F.col("_parent")) & (F.col("name") == new_name))
                 .select(F.col("node_id").alias("_exist"), F.col("count").alias("_exist_count")))
    existing = existing.join(merged_ids.withColumnRenamed("node_id", "_exist"), "_exist", "left_anti")
    victims = merged_ids.join(existing.select(F.col("_exist").alias("node_id")), "node_id", "left_anti")
    gone = (t.select("node_id", F.explode("path").alias("_v"))
             .join(victims.withColumnRenamed("node_id", "_v"), "_v", "left_semi").select("node_id"))
    kept = t.join(gone, "node_id", "left_anti")
    agg = agg.crossJoin(t.agg((F.max("node_id") + 1).alias("_free")))  # one row x one row
    info = agg.crossJoin(existing.groupBy().agg(F.first("_exist").alias("_exist"),
                                                F.first("_exist_count").alias("_exist_count")))
    add = F.coalesce(F.col("_exist_count"), F.lit(0)) if keep_existing_count else F.lit(0)
    kept = kept.crossJoin(F.broadcast(info)).withColumn(
        "count", F.when(F.col("node_id") == F.col("_exist"), F.col("_total") + add).otherwise(F.col("count")))
    kept = kept.withColumn("desc", F.when(F.col("node_id") == F.col("_exist"), F.lit(new_desc))
                                     .otherwise(F.col("desc")))
    new_node = info.filter(F.col("_exist").isNull() & F.col("_total").isNotNull()).select(
        F.col("_free").alias("node_id"), (F.col("_lvl")).alias("lvl"), F.lit(new_name).alias("name"),
        F.col("_total").alias("count"), F.lit(new_desc).alias("desc"), F.col("_parent").alias("parent_id"))
    cols = ["node_id", "lvl", "name", "count", "desc", "parent_id"]
    return kept.select(*cols).unionByName(new_node.select(*cols))


def drop_rare_topics(tree: DataFrame, frac: float = 0.01) -> DataFrame:
    """Keep topics whose share of their level's total count is >= ``frac``."""
    tot = tree.groupBy("lvl").agg(F.sum("count").alias("_tot"))  # one row per level
    return (tree.join(F.broadcast(tot), "lvl").filter(F.col("count") / F.col("_tot") >= frac)
                .drop("_tot"))


def topic_top_words(tree: DataFrame, n: int = 10, id_col: str = "node_id",
                    filler: Sequence[str] = TOPIC_FILLER) -> DataFrame:
    """Top ``n`` words of each topic description: lower-cased ``[a-zA-Z']+``
    counts minus filler words; ties by first appearance.  Keyed by node id
    (the reference keys by level, which collapses all topics into one)."""
    words = tree.select(id_col, F.posexplode(F.regexp_extract_all(F.lower("desc"), F.lit(DESC_WORD_RE), 0))
                        .alias("pos", "word")).filter(~F.col("word").isin(list(filler)))
    counts = words.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(id_col).orderBy(F.col("n").desc(), F.col("first"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
                  .select(id_col, F.col("rank").cast("int").alias("rank"), "word", F.col("n").alias("count")))


# ---------------------------------------------------------------- prompts
# Default token estimator: runs of letters/digits/underscore, or any single
# other non-space character (a parameter; the model tokenizer is not built).
TOKEN_EST_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _WS + r"]"


def estimate_tokens(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_EST_RE)), F.lit(0))


def _fill(template: str, values: dict) -> F.Column:
    """``template.format(**values)`` as a column: literal pieces (with ``{{``
    and ``}}`` unescaped) concatenated with the value columns, so text inside a
    value is never substituted again."""
    import string
    parts = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts) if parts else F.lit("")


def _words(c: F.Column) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def word_cosine(topic: F.Column, doc_words: F.Column) -> F.Column:
    """Cosine of the word sets of a topic and a document, but for the document's own length."""
    words = _words(topic)
    return F.size(F.array_intersect(doc_words, words)) / F.sqrt(F.greatest(F.size(words), F.lit(1)).cast("double"))


def build_prompts(docs: DataFrame, topic_list_df: DataFrame, template: str, context_len: int,
                  max_top_len: int = 500, doc_col: str = "text", estimator=estimate_tokens,
                  similarity=word_cosine) -> DataFrame:
    """Fill ``{Document}`` and ``{Topics}`` for every document.

    ``topic_list_df`` is ``(order, topic)``; the prompt lists topic names
    (text before the first ``:``).  When the prompt exceeds ``context_len``, a
    document longer than ``context_len - prompt - max_top_len`` is cut after
    that many estimator tokens (a prefix of the original text).  If the topics
    still do not fit, the most similar ones that fit in what is left are
    listed, best first (``pruned``; ties by text): a running sum of their
    tokens stays within the budget.  The topic list is one value, bounded by
    the topic tree and joined by broadcast; similarity is computed inside the
    row, so no document x topic table is made.  A null text counts as empty.
    """
    import string
    names = topic_list_df.select(F.trim(F.split(F.col("topic"), ":")[0]).alias("t"), "order")
    tlist = names.agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "t"))), lambda s: s["t"]).alias("_topics"))
    prompt_only = "".join(lit for lit, _f, _s, _c in string.Formatter().parse(template))
    d = docs.crossJoin(F.broadcast(tlist)).withColumn("topic_str", F.array_join("_topics", "\n"))  # one-row table
    text = F.coalesce(F.col(doc_col), F.lit(""))
    prompt_len = estimator(F.lit(prompt_only))
    doc_len, topic_len = estimator(text), estimator("topic_str")
    over = prompt_len + doc_len + topic_len > context_len
    budget = F.greatest(F.lit(context_len) - prompt_len - max_top_len, F.lit(0))
    trunc = over & (doc_len > budget)
    # whatever is no token is white space before one: the pieces joined again are the text
    pieces = F.regexp_extract_all(text, F.lit(f"[{_WS}]*(?:{TOKEN_EST_RE})"), 0)
    d = d.withColumn("truncated", trunc)
    d = d.withColumn("_doc", F.when(F.col("truncated"), F.array_join(F.slice(pieces, 1, budget), "")).otherwise(text))
    d = d.withColumn("_room", F.lit(context_len) - prompt_len - estimator("_doc"))
    d = d.withColumn("pruned", topic_len > F.col("_room"))
    ranked = F.array_sort(F.transform("_topics", lambda t: F.struct((-similarity(t, F.col("_dw"))).alias("s"), t.alias("t"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("kept"))
    best = F.aggregate(ranked, none, lambda acc, x: F.struct(
        (acc["n"] + estimator(x["t"])).cast("long").alias("n"),
        F.when(acc["n"] + estimator(x["t"]) <= F.col("_room"), F.concat(acc["kept"], F.array(x["t"]))).otherwise(acc["kept"]).alias("kept")),
        lambda acc: acc["kept"])
    d = d.withColumn("_dw", F.when(F.col("pruned"), _words(F.col("_doc"))))
    shown = F.when(F.col("pruned"), F.array_join(best, "\n")).otherwise(F.col("topic_str"))
    filled = _fill(template, {"Document": F.col("_doc"), "Topics": shown})
    return d.withColumn("prompt", filled).drop("_topics", "_doc", "_room", "_dw")


def prune_topics(sims: DataFrame, budget: DataFrame, doc_col: str = "doc_pos", topic_col: str = "topic",
                 sim_col: str = "sim", estimator=estimate_tokens) -> DataFrame:
    """Greedy prefix of topics by similarity under a token budget per document.

    ``sims``: ``(doc, topic, sim)``; ``budget``: ``(doc, max_top_len)``.  A
    running sum of topic tokens (plain prefix sum - the reference adds the
    length of the whole accumulated string, a noted divergence), ties by
    topic text.  The window is partitioned by document.
    """
    w = Window.partitionBy(doc_col).orderBy(F.col(sim_col).desc(), F.col(topic_col)) \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = estimator(F.concat(F.col(topic_col), F.lit("\n")))
    ranked = sims.join(budget, doc_col).withColumn("_run", F.sum(cost).over(w))
    return ranked.filter(F.col("_run") <= F.col("max_top_len")).drop("_run")
