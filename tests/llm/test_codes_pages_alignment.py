"""Vector codes, page text and token alignment against brute force, with nulls, ties, copies and empty tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import alignment, codes, page_text


# ------------------------------------------------------------------- codes
def test_gnat_finds_the_lowest_nearest_entry_and_skips_subtrees():
    rnd = np.random.default_rng(3)
    for size, width, span in ((1, 8, 9), (16, 8, 4000), (16, 2, 3), (40, 3, 2), (256, 8, 500), (16, 8, 1)):
        entries = rnd.integers(-span, span, (size, width))
        points = np.concatenate([rnd.integers(-span, span, (300, width)), entries])
        tree = codes.Gnat(entries)
        index, d = tree.nearest(points)
        want = ((points[:, None] - entries[None]) ** 2).sum(-1)
        assert (index == want.argmin(1)).all() and (d == want.min(1)).all()
    line = np.arange(256)[:, None] * 1000
    tree = codes.Gnat(line)
    assert (tree.nearest(line)[0] == np.arange(256)).all()
    assert tree.compared < 256 * 256 // 3  # most subtrees are never compared


def _codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, q, _ in kept:
        first[i] = min(first.get(i, q), q, key=lambda z: np.array(z, "<i4").tobytes())
    ids = sorted(first, key=lambda i: (i is None, i))[:entries]
    w = len(kept[0][1]) // parts
    books = [[first[i][p * w:(p + 1) * w] for i in ids] for p in range(parts)]
    sq = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(q, p):
        part = q[p * w:(p + 1) * w]
        return min((sq(part, e), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q, _ in kept:
            for p in range(parts):
                groups[p, nearest(q, p)[1]].append(q[p * w:(p + 1) * w])
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out, by_label = [], Counter()
    for i, q, label in kept:
        found = [nearest(q, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, c, e, by_label[label], digest) for i, c, e, label in out)


VECTORS = "vec_id long, embedding array<double>, label int, code string, q string, lk int"


@pytest.mark.parametrize("n", [40, 9])
def test_vector_codes_match_plain_lloyd_rounds(spark, n):
    rnd = random.Random(n)
    rows = [(i, [rnd.choice([-1.5, -0.25, 0.0, 0.1, 0.3, 1.0]) for _ in range(16)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += [rows[3], (3, rows[5][1], None), (None, rows[4][1], 2), (500, None, 1), (501, [0.5] * 15 + [None], 1),
             (502, [0.5] * 15 + [math.nan], 1), (503, [math.inf] * 16, 1), (504, [], None)]
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], VECTORS).repartition(5)
    got = Counter(tuple(r) for r in codes.vector_codes(df).collect())
    assert got == _codes(rows)


def test_vector_codes_of_nothing_and_of_unequal_lengths(spark):
    empty = spark.createDataFrame([], VECTORS)
    out = codes.vector_codes(empty)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    with pytest.raises(ValueError):
        codes.vector_codes(spark.createDataFrame([(1, [1.0] * 8, 0, "", "", 1), (2, [1.0] * 16, 0, "", "", 1)], VECTORS))


def test_label_errors_join_by_salt_where_labels_are_many(spark, monkeypatch):
    monkeypatch.setattr(codes.C, "BROADCAST_ROWS", 1)
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(8)], rnd.choice([None, 0, 1, 2, 2, 2, 2])) for i in range(60)]
    df = spark.createDataFrame([(*r, "c", "c", 7) for r in rows], VECTORS)
    assert Counter(tuple(r) for r in codes.vector_codes(df).collect()) == _codes(rows)


# ------------------------------------------------------------------- pages
def test_common_lines_is_a_longest_common_subsequence():
    rnd = random.Random(8)
    for _ in range(300):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(14))]
        b = [rnd.randrange(5) for _ in range(rnd.randrange(14))]
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        for limit in (1 << 28, 4):  # in one table, and halved again and again
            ia, ib = page_text.common_lines(a, b, limit)
            assert len(ia) == length[-1][-1] and [a[i] for i in ia] == [b[i] for i in ib]
            assert ia == sorted(set(ia)) and ib == sorted(set(ib))


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b<p> ", "a\nb"),
    ("<nav>menu<p>more</nav><article><header><h1>T &amp; U</h1></header><p>x<br>y&nbsp;z &#233;</p></article><footer>f", "T & U\nx y z é"),
    ("<header>site</header><main><p>one</p><aside>side</aside><form>f</form><p>two", "one\ntwo"),
    ('<body><div class="ad">buy</div><div class="content">keep</div><p class="Cookie-Notice">no</p><p>yes</p>', "keep\nyes"),
    ('<article>a<section id="comments"><article>c</article></section><p>b</p></article>', "a\nb"),
    ('<script>var t="</p><p>no";</script><style>p{}</style><p>1 < 2 &lt; 3</p><!-- <p>no</p> --><p>4', "1 < 2 < 3\n4"),
    ("<p>cut &am", "cut &am"), ("<p>open tag <a href='x", "open tag"), ("<P>Up</P><DIV ROLE=navigation>no</DIV>", "Up"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<p>a</b></article></p>b", "a\nb"), ("<p>x<!-- never closed", "x"),
    ("<script>never closed <p>no", ""), ("<div hidden>no</div><div style='display: none'>no</div><li>yes", "yes"),
])
def test_page_lines(page, want):
    lines, zones = page_text.page_lines(page)
    assert "\n".join(x for x, z in zip(lines, zones) if z != page_text.CHROME) == want


PAGES = "page_id long, url string, html string, text string, lines string, k1 string, at string"


def _page(body):
    return f"<html><body><div>Big Site</div><p>All news of the day</p>{body}<div>All rights kept by Big Site</div>"


def _words(i):
    return " ".join(f"w{i}x{j}" for j in range(14))


def test_lines_shared_with_the_nearest_url_are_deleted(spark):
    rows = [(i, f"http://h.example/{'ab'[i % 2]}/{i}", _page(f"<p>{_words(i)}</p><p>short {i}</p>")) for i in range(20)]
    rows += [(20, "http://h.example/a/0?copy", rows[0][2]), (21, "http://h.example/a/0?near", rows[0][2].replace("short 0", "short z"))]
    rows += [(30, "http://alone.example/", _page("<p>alone</p>")), (31, None, _page("<p>none</p>")), (32, "http://[bad", "<p>bad</p>"),
             (33, "http://h.example/a/2", None), (34, "http://h.example/a/2", "")]
    rows += [(40, "http://x.example/1", "<nav>Home</nav><article><p>same</p><p>one</p></article>"),
             (41, "http://x.example/2", "<nav>Home</nav><article><p>same</p><p>two</p></article>")]
    rows += [rows[4], (None, rows[6][1], rows[6][2])]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], PAGES).repartition(3)
    got = defaultdict(set)
    for r in page_text.main_text(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].add(r.text)
    kept = {i: f"{_words(i)}\nshort {i}" for i in range(20)}
    whole = lambda body: f"Big Site\nAll news of the day\n{body}\nAll rights kept by Big Site"
    for i in range(20):
        assert got[i] == {kept[i]}, i
    # copies and near copies give no evidence against each other: the next nearest page does
    assert got[20] == {kept[0]} and got[21] == {kept[0].replace("short 0", "short z")}
    assert got[None] == {kept[6]}
    assert got[30] == {whole("alone")} and got[31] == {whole("none")} and got[32] == {"bad"}
    assert got[33] == got[34] == {""}
    assert got[40] == {"same\none"} and got[41] == {"same\ntwo"}  # article lines stay
    assert page_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_pairing_does_not_depend_on_runs_or_partitions(spark):
    from gleaner.llm.common import Stages
    rows = [(i, f"http://h.example/{i:03d}", _page(f"<p>{_words(i)}</p>"), "", "", "", "") for i in range(50)]
    want = None
    for run, parts in ((512, 1), (7, 3), (1, 6)):
        df = spark.createDataFrame(rows, PAGES).repartition(parts)
        stages = Stages(spark, "test")
        parsed = df.select("page_id", "url", "html").mapInArrow(page_text._parse, page_text._PARSED.format(id="long"))
        got = sorted((r.k1, r.k2, tuple(r.shared)) for r in page_text.shared_lines(parsed, stages, run).collect())
        assert len(got) == 50 and (want is None or got == want)
        want = got


# --------------------------------------------------------------- alignment
TEXTS = [None, "", "a", " ", "  two  spaces ", "The quick brown fox", "naïve café — 日本語 🙂", "tab\tnew\nline\r\n", "<|endoftext|> <s> </s> <0x41>",
         "low ▁ block", "nul\0byte", "aaaaaaaaaaaa aaa aa", "The quick brown fox", "x" * 700, "ﬁ Ⅳ ½", "1234567890 3.14", "The fox. The fox. The fox."]


def _aligned(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    pair = alignment.tokenizers(alignment.TOKENIZER_A, alignment.TOKENIZER_B)
    known = Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
    known.encode_special_tokens = True
    docs, count = [], Counter()
    for t in texts:
        ids = ([], [])
        if t:
            ids = known.encode(" " + t, add_special_tokens=False).ids, pair.b.model.encode(t)
            raw = (" " + t).encode()
            if any(b"".join(v[i] for i in x) != raw for v, x in zip((pair.a.tokens, pair.b.tokens), ids)):
                ids = ([], [])
        spans = []
        for vocabulary, x in zip((pair.a.tokens, pair.b.tokens), ids):
            at, one = 0, []
            for i in x:
                one.append((i, at, at + len(vocabulary[i])))
                at = one[-1][2]
            spans.append(one)
        links = [(a, b) for a, s, e in spans[0] for b, u, v in spans[1] if s < v and u < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= c) for side in spans))
            low = c
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        docs.append((len(ids[0]), len(ids[1]), len(cuts), links, digest))
        count.update(set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(n_a, n_b, n_g, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest)
            for n_a, n_b, n_g, links, digest in docs]


@pytest.mark.parametrize("block_bytes, heavy", [(8 << 20, 50_000), (20, 50_000), (20, 1)])
def test_alignment_matches_brute_force(spark, monkeypatch, block_bytes, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    monkeypatch.setattr(alignment.C.runs_of_texts, "__defaults__", (16,))
    texts = TEXTS + ["the common text of many rows"] * 30 + ["word " * 400]
    ids = list(range(len(texts) - 2)) + [None, 0]
    df = spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in zip(ids, texts)],
                               "doc_id long, text string, block int, pos int, ids string").repartition(4)
    got = Counter(tuple(r) for r in alignment.token_alignment(df, block_bytes=block_bytes).collect())
    assert got == Counter((i, *x) for i, x in zip(ids, _aligned(texts)))


def test_alignment_of_an_empty_table(spark):
    out = alignment.token_alignment(spark.createDataFrame([], "doc_id string, text string"))
    assert out.count() == 0
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
