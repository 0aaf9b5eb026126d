"""The training-data operators against brute force on small tables and on sf0.001."""

from __future__ import annotations

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lexspark.llm import ann_tree, html_paths, katz, line_dedup, orc_tokens, packing, parity_join, quality, token_count, unigram_pieces
from lexspark.llm.queries import BYTE_BPE, PIECES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("keys", T.StringType()), T.StructField("n_lines", T.LongType())])
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
EDGE = [
    (1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "a b c d"), (7, "a b c d"), (7, "another text of the same id"),
    (None, "no id here"), (None, "no id here"), (8, LONG), (9, LONG), (10, "Ünïcödé – „text“ 中文字符  ☃ x\r\ny"), (11, "x <|endoftext|> y<|endoftext|>"),
    (12, f"first own line\n{PASSAGE}\nlast"), (13, f"{PASSAGE}\nsome end"), (14, "dup line\ndup line\n\nother"), (15, "\n".join([f"l{i} " * 12 for i in range(8)])), (16, "intro\n" + "\n".join([f"l{i} " * 12 for i in range(8)])),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE).cache()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def words(text):
    return WORD.findall(text or "")


def test_quality_counts(edge):
    def brute(t):
        w, t = words(t), t or ""
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.rule_stats(edge).collect())
    assert got == collections.Counter((i, *brute(t)) for i, t in EDGE)


def test_quality_verdict(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.judge_documents(documents, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == documents.count()
    assert all(not (r.kept and r.base_failed) for r in rows)
    passed = [r for r in rows if not r.base_failed and r.doc_id in truth]
    good = [r.kept for r in passed if truth[r.doc_id] == 1]
    bad = [r.kept for r in passed if truth[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and (not bad or np.mean(bad) < 0.4)
    kept = {r.doc_id for r in quality.keep_documents(documents, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}


def test_quality_without_labels(spark, edge, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0)
    assert {r.doc_id for r in quality.judge_documents(edge, labels).where("kept").collect()} == {8, 9, 12, 13}
    assert quality.judge_documents(edge.limit(0), labels).count() == 0


def test_unigram_pieces_are_best(edge):
    own = unigram_pieces.UnigramPieces(tokenizer_path(PIECES))
    numbers = {p: i for i, p in enumerate(own.pieces) if not (own.model.is_control(i) or own.model.is_unknown(i) or own.model.is_byte(i) or own.model.is_unused(i))}

    def best(text):
        value = [0.0] + [-math.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 20), e):
                if text[s:e] in numbers:
                    value[e] = max(value[e], value[s] + own.scores[numbers[text[s:e]]])
            if text[e - 1 : e] not in numbers:
                value[e] = max(value[e], value[e - 1] + own.unknown_score)
        return value[-1]

    rng = np.random.default_rng(8)
    bits = ["the", "regulation", " ", "  ", "x", "Ü", "☃", "中", "▁", "\x1f", "q", "zz", "\n", "0"]
    for text in ["the general data protection regulation", "Ünïcode ☃ text", "中文", "a  b ", "x" * 40, *("".join(rng.choice(bits, 9)) for _ in range(200))]:
        normal = own.model.normalize(text)
        found, ends = own.encode([normal])
        ids = found.tolist()
        run, total = 0, 0.0
        for is_byte, group in itertools.groupby(ids, lambda i: i in own.byte_of):
            group = list(group)
            total += own.unknown_score * len(bytes(own.byte_of[i] for i in group).decode()) if is_byte else sum(own.scores[i] for i in group)
        assert total == best(normal)
        assert own.decode(found, ends) == [normal.replace("▁", " ").removeprefix(" ")] == [own.model.decode(ids)]
    rows = unigram_pieces.piece_digests(edge, tokenizer_path(PIECES)).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip for r in rows)
    back = unigram_pieces.decode_pieces(unigram_pieces.encode_pieces(edge, tokenizer_path(PIECES)), tokenizer_path(PIECES)).collect()
    assert sorted(r.text for r in back if r.doc_id == 5) == ["one two"]


def test_line_dedup_edges(edge):
    rows = {(r.doc_id, r.n_deleted_lines, r.text) for r in line_dedup.dedup_lines(edge).collect()}
    by_id = {r[0]: r for r in rows}
    assert by_id[12][2] == f"first own line\n{PASSAGE}\nlast" and by_id[13] == (13, 1, "some end")
    assert by_id[8][1] == 0 and by_id[9] == (9, 1, "")
    assert by_id[15][1] == 0 and by_id[16] == (16, 8, "intro")
    assert by_id[1][2] is None and by_id[2][2] == "" and by_id[14][1] == 0
    assert line_dedup.dedup_lines(edge).count() == len(EDGE)
    assert line_dedup.dedup_lines(edge.limit(0)).count() == 0
    assert line_dedup.dedup_lines(edge).columns == ["doc_id", "text", "lang", "keys", "n_lines", "n_deleted_lines", "n_deleted_words"]


def test_clashing_names(spark):
    """Columns named like those that the operators make inside come through unchanged."""
    names = ["doc_id", "text", "th", "row", "runs", "key", "__th", "__runs", "component_id", "rn"]
    rows = [(i, PASSAGE, *(f"{n}{i}" for n in names[2:])) for i in (1, 2)] + [(3, None, *names[2:]), (None, "", *names[2:])]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    out = line_dedup.dedup_lines(table)
    assert {tuple(r)[2 : len(names)] for r in out.collect()} == {r[2:] for r in rows} and out.columns[: len(names)] == names
    assert {tuple(r) for r in parity_join.one_of_each(table).collect()} == {rows[0], *rows[2:]}


def test_line_dedup_leaves_no_long_repeat(documents, texts):
    after = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents).collect()}
    seen: set = set()
    for i in sorted(after):
        for line in after[i].split("\n"):
            if len(words(line)) >= 50:
                assert line.strip() not in seen
                seen.add(line.strip())
    kept = {x.strip() for t in after.values() for x in t.split("\n")}
    assert all(x.strip() in kept for t in texts.values() for x in t.split("\n"))


def line_dedup_brute(docs, min_words=50):
    """doc_id -> text without the lines of runs of min_words words or more that begin earlier too."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, gone = text.split("\n"), set()
        for s, e in itertools.combinations(range(len(lines) + 1), 2):
            if sum(len(x.split()) for x in lines[s:e]) >= min_words:
                run = tuple(lines[s:e])
                gone |= set(range(s, e)) if run in seen else set()
                seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_finds_all_runs(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a, b, c, d = line("a", 29), line("b", 28), line("c", 20), line("d", 9)
    docs = [(1, f"{line('o', 9)}\n{a}\n{b}\n{line('p', 9)}"), (2, f"{line('q', 9)}\n{a}\n{b}\n{line('r', 9)}"),  # two short lines
            (3, f"{c}\n{d}\n{line('s', 9)}"), (4, f"{c}\n{d}\n{line('t', 30)}\n{line('u', 9)}"), (5, f"{line('v', 9)}\n{c}\n{d}\n{line('t', 30)}\n{line('x', 9)}")]
    random = np.random.default_rng(1)
    stock = [line(f"k{k}_", n) for k, n in enumerate([5, 11, 18, 25, 35, 49, 50, 60])]
    docs += [(10 + i, "\n".join(stock[k] for k in random.integers(0, len(stock), random.integers(1, 9)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got == line_dedup_brute(docs)
    assert got[2] == f"{line('q', 9)}\n{line('r', 9)}" and got[5] == f"{line('v', 9)}\n{line('x', 9)}"


def test_token_counts(edge, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    for docs in (edge, documents):
        expected = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs, tokenizer_path(BYTE_BPE)).collect()) == expected


def test_token_counts_of_rare_characters():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    texts = ["".join(f"a{chr(c)} {chr(c)}b" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in range(1, 0x3000, 64)]
    assert token_count.token_counts(texts, tokenizer_path(BYTE_BPE)) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing(edge, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    for docs in (edge, documents):
        rows = packing.pack(docs, tokenizer_path(BYTE_BPE), block_tokens=50_000).collect()
        expected = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in docs.collect())
        pieces, places = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4")
            assert len(ids) == r.length
            pieces[r.doc_id].append((r.start, r.doc_tokens, tuple(ids.tolist())))
            places[r.sequence_id].append((r.offset, r.length))
        assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in expected.items())
        for (doc, ids), n in expected.items():
            assert sum(p[2] == ids[p[0] : p[0] + len(p[2])] and p[1] == len(ids) for p in pieces[doc]) >= n
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack(edge.limit(0), tokenizer_path(BYTE_BPE)).count() == 0


def test_best_fit_takes_the_tightest_window():
    windows = packing.best_fit_decreasing([6, 5, 4, 4, 3, 2], 10)
    assert sorted(sorted(w) for w in windows) == [[0, 2], [1, 3], [4, 5]]
    tree = packing.CapacityTree(10)
    for room, w in ((3, 0), (7, 1), (10, 2)):
        tree.add(room, w)
    assert [tree.take_tightest(4), tree.take_tightest(4), tree.take_tightest(4), tree.take_tightest(1)] == [(7, 1), (10, 2), None, (3, 0)]


def test_orc_tokens(spark, edge, documents, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    for k, docs in enumerate((edge, documents)):
        path = str(tmp_path / f"ids{k}")
        orc_tokens.write_token_ids(docs, path, tokenizer_path(BYTE_BPE))
        rows = orc_tokens.token_digests(spark, path).orderBy("start").collect()
        expected = collections.Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == collections.Counter({(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())): n for (i, x), n in expected.items()})
        ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
        assert ids == sorted(ids)
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        assert orc_tokens.read_token_ids(spark, path).where("doc_id = 5").count() == sum(i == 5 for i, _ in expected.elements())
    one_id = frame(spark, [(5, f"{k} text")  for k in range(400)] + [(5, "same")] * 400)
    path = str(tmp_path / "one-id")
    orc_tokens.write_token_ids(one_id, path, tokenizer_path(BYTE_BPE))
    rows = orc_tokens.token_digests(spark, path).orderBy("start").collect()
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1] and len(rows) == 800
    assert spark.read.orc(path).select("range_no").distinct().count() > 1
    path = str(tmp_path / "none")
    orc_tokens.write_token_ids(edge.limit(0), path, tokenizer_path(BYTE_BPE))
    assert orc_tokens.token_digests(spark, path).count() == 0


def test_orc_stripes_are_pruned(spark, documents, tmp_path):
    """The files hold stripes, row indexes and Bloom filters, and a doc_id is found without reading the other stripes."""
    from pyarrow import orc

    many = spark.range(60_000).selectExpr("id * 3 as doc_id", "concat('text of row ', id) as text").repartition(3)
    path = str(tmp_path / "ids")
    orc_tokens.write_token_ids(many, path, tokenizer_path(BYTE_BPE), stripe_mb=0)
    files = sorted(p for p in (tmp_path / "ids").glob("*.orc"))
    opened = [orc.ORCFile(str(p)) for p in files]
    assert sum(f.nrows for f in opened) == 60_000
    spans = sorted((min(x), max(x)) for f in opened for k in range(f.nstripes) if (x := f.read_stripe(k, columns=["doc_id"]).column(0).to_pylist()))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # stripes don't overlap, so min and max prune
    plan = orc_tokens.read_token_ids(spark, path).where("doc_id = 300")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,300)" in plan
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    rows = reader.rows()
    streams = {(s.getColumn(), s.getKind().toString()) for s in rows.readStripeFooter(reader.getStripes().get(0)).getStreamsList()}
    assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8")} <= streams and (2, "BLOOM_FILTER_UTF8") not in streams
    assert reader.getRowIndexStride() == 10_000
    rows.close()


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, 2.0]), (904, [None] * 8), (None, rows[3][1]), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann_tree.nearest(table, table.where("vec_id % 50 = 0"), target_recall=1.0, leaf_rows=16, block_rows=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in good if i % 50 == 0}
    hit = total = 0
    for q, found in got.items():
        near = sorted((-round(float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), 12), i) for i, v in good.items() if i != q)[:5]
        hit += len({i for _, i in near} & {i for i, _ in found})
        total += 5
        assert len(found) == 5 and [i for i, _ in found] == [i for _, i in sorted((-round(s, 12), i) for i, s in found)]
    assert hit / total >= 0.99
    assert ann_tree.nearest(table.limit(0), table).count() == 0


def test_nearest_recall_as_registered(spark):
    """The registered setting on clustered vectors, measured on queries that the calibration hasn't seen."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 24))
    rows = centres[rng.integers(0, 60, 12_000)] + rng.normal(scale=0.7, size=(12_000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(set)
    for r in ann_tree.nearest(table, table.where("vec_id % 50 = 0"), calibration=60).collect():
        got[r.query_id].add(r.vec_id)
    near = ann_tree.unit(rows)
    hits = []
    for q in range(0, 12_000, 50):
        score = near @ near[q]
        score[q] = -2
        hits.append(len(got[q] & set(np.argsort(-score)[:5].tolist())) / 5)
    assert len(hits) == 240 and np.mean(hits) >= 0.9


def katz_brute(docs):
    docs = [(i, words((t or "").translate(LOWER)) + [None]) for i, t in docs]
    train = [w for i, w in docs if katz.in_training(i)]
    one = collections.Counter(x for w in train for x in w)
    two = collections.Counter(p for w in train for p in zip(["<start>", *w], w))
    total, distinct = sum(one.values()), len(one)
    context = collections.Counter()
    for (v, _), c in two.items():
        context[v] += c

    def discounts(counts):
        n = collections.Counter(counts)
        q = 6 * n[6] / n[1] if n[1] else 1
        d = {r: (((r + 1) * n[r + 1] / n[r]) / r - q) / (1 - q) if n[r] and q < 1 else 1 for r in range(1, 6)}
        d = {r: x if 0 < x <= 1 else 1 for r, x in d.items()}
        return (lambda c: d.get(c, 1)) if q < 1 and any(d[r] < 1 and n[r] for r in d) else (lambda c: (c - 0.5) / c)

    d1, d2 = discounts(one.values()), discounts(two.values())
    unknown = 1 - sum(d1(c) * c for c in one.values()) / total if total else 1.0
    p1 = lambda w: d1(one[w]) * one[w] / total if one[w] else unknown
    seen, freed = collections.Counter(), collections.Counter()
    for (v, w), c in two.items():
        seen[v] += d2(c) * c / context[v]
        freed[v] += p1(w)

    def p2(v, w):
        if not context[v]:
            return p1(w)
        scale = context[v] / (context[v] + 1) if seen[v] > 1 - 1e-12 else 1
        return d2(two[v, w]) * two[v, w] * scale / context[v] if two[v, w] else (1 - seen[v] * scale) / (1 - freed[v]) * p1(w)

    rows = [(i, not katz.in_training(i), len(w), sum(one[x] > 0 for x in w), total, sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in w), sum(math.log10(p2(v, x)) for v, x in zip(["<start>", *w], w))) for i, w in docs]
    return rows, (one, p2)


@pytest.mark.parametrize("bucket_tokens", [2_000_000, 3_000])
def test_katz(edge, documents, bucket_tokens):
    for docs in (edge, documents):
        expected, (one, p2) = katz_brute([(r.doc_id, r.text) for r in docs.collect()])
        got = [tuple(r) for r in katz.score_texts(docs, bucket_tokens=bucket_tokens).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
        assert len(got) == len(expected)
        for a, b in zip(sorted(got, key=key), sorted(expected, key=key)):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    for v in ("the", "<start>", "never seen"):
        assert sum(p2(v, w) for w in one) + p2(v, "not a word") == pytest.approx(1)


def test_katz_empty(edge):
    assert katz.score_texts(edge.limit(0)).count() == 0


def test_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html_paths.extract_main_text(pages).collect()
    import html

    for r, p in zip(sorted(rows), sorted(pages.collect())):
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_main_text_layouts(spark):
    page = """<html><body><header class="site-header"><h1>Site</h1></header><div id="sidebar"><p>Side text here, long enough to count.</p></div>
    <div class="content"><h1>Title &amp; more</h1><p>First paragraph, with <a href=x>a link</a> and text.</p><p>Short.</p><ul><li>one<li>two</ul></div>
    <div class="comments"><p>I agree, nice article, thanks for it all.</p></div><form><p>Name</p></form><div class="cookie-notice">We use cookies, okay?</div><footer>&copy; x</footer></body></html>"""
    assert html_paths.main_text(page) == "Title & more\nFirst paragraph, with a link and text.\nShort.\none\ntwo"
    assert [html_paths.main_text(x) for x in (None, "", "plain &lt;b", "<p>a<p>b", "<script>x</script>")] == ["", "", "plain <b", "a\nb", ""]
    rows = [(1, None, None), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, "u", "")]
    assert html_paths.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 4


def test_main_text_of_other_layouts():
    body = [f"Paragraph {k} of the body, with a sentence, and another one; it goes on for a while." for k in range(6)]
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    teaser = "<article><p>A teaser, with some text of its own.</p></article>"
    whole = "\n".join(body)
    assert html_paths.main_text(f"<body><main>{paragraphs}</main>{teaser}</body>") == whole
    assert html_paths.main_text(f"<body><div class='page has-sidebar'><div>{paragraphs}</div><div class='sidebar'><p>Side, text.</p></div></div></body>") == whole
    assert html_paths.main_text(f"<body><article>{paragraphs}</article><article><p>A short one, but whole.</p></article></body>") == f"{whole}\nA short one, but whole."
    assert html_paths.main_text(f"<body><div>{paragraphs}</div>{teaser}</body>").startswith(whole)
    assert html_paths.main_text(f"<body><div>{paragraphs * 2}</div><section><p>{body[0]}</p></section></body>") == f"{whole}\n{whole}\n{body[0]}"
    assert html_paths.main_text(f"<body><div><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div>{paragraphs}</div><div><span>Imprint</span></div></body>") == whole
    assert html_paths.main_text(f"<body><article>{paragraphs}</article><div class=comments>{paragraphs * 2}</div></body>") == whole


def test_main_text_within_a_form_or_noscript():
    body = [f"Paragraph {k} of the body, with a sentence, and another one; it goes on for a while." for k in range(6)]
    paragraphs, whole = "".join(f"<p>{x}</p>" for x in body), "\n".join(body)
    controls = "<label>Search</label><input name=q><select><option>One</select><textarea>typed</textarea><button>Go</button>"
    assert html_paths.main_text(f"<body><form id=server-form>{controls}<nav>Menu</nav><div>{paragraphs}</div></form></body>") == whole
    assert html_paths.main_text(f"<body><noscript><div>{paragraphs}</div></noscript><script>document.write('x')</script></body>") == whole
    assert html_paths.main_text(f"<body><div>{paragraphs}<form><p>Your name, please.</p>{controls}</form><noscript><img src=t>Enable it.</noscript></div></body>") == whole
    assert html_paths.main_text(f"<body><div><div>{paragraphs}</div><div class=discussion><p>I agree, nice article, thanks for it all.</p></div></div></body>") == whole


def test_main_text_follows_the_path_scores(spark, sf_dir, monkeypatch):
    """Without the scores of the tag paths the result is another one."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    right = [html_paths.main_text(x) for x in pages]
    rng = np.random.default_rng(4)
    for scores in (lambda blocks, *_: rng.random(len(blocks)), lambda blocks, *_: np.ones(len(blocks))):
        monkeypatch.setattr(html_paths, "path_scores", scores)
        assert np.mean([html_paths.main_text(x) != y for x, y in zip(pages, right)]) > 0.1


def test_main_text_keeps_the_article_whole():
    page = """<article><div class="entry-header"><h1>Title</h1></div><p>Body text, which is long enough.</p><p class="tags-legal">Legal tags.</p><div class="share-of-market">Share, of the market.</div></article>"""
    assert html_paths.main_text(page) == "Title\nBody text, which is long enough.\nLegal tags.\nShare, of the market."


@pytest.mark.parametrize("page", ["<a " * 330_000, "<div>x" * 20_000, "</x>" * 200_000, "<div>" * 20_000 + "<li>x</li>" * 20_000, '<a title="x>y ' * 70_000, "<" * 300_000, "<span>" * 20_000 + "x<br>" * 20_000, "<div class=ad>x" * 5_000])
def test_main_text_in_linear_time(page):
    import time

    start = time.process_time()
    html_paths.main_text(page)
    assert time.process_time() - start < 8


def jaccard_brute(docs, k, percent):
    rows = [(i, (t or "").translate(LOWER)) for i, t in docs]
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    first: dict = {}
    for n, (i, _) in enumerate(rows):
        r = find(n)
        if i is not None:
            first[r] = min(first.get(r, i), i)
    return collections.Counter((i, len(s), first.get(find(n)) if s else i) for n, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_parity_join(edge, documents, k, percent):
    for docs in (edge, documents):
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.near_duplicates(docs, k, percent).collect())
        assert got == jaccard_brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_parity_join_large_group(spark):
    """A chain-like group of near copies, more than fits a chunk, whose links don't all go through one document."""
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.choice(150, rng.integers(0, 4), replace=False):
            own[at] = f"e{i}n{at}"
        rows.append((i, " ".join(own)))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.near_duplicates(frame(spark, rows), 3, 90).collect())
    assert got == jaccard_brute(rows, 3, 90)
    assert parity_join.near_duplicates(frame(spark, rows).limit(0), 3, 90).count() == 0


def test_one_of_each(edge):
    """Of each component the smallest doc_id stays, and every row without words."""
    first = {}
    for doc, _, component in jaccard_brute(EDGE, 5, 80):
        first.setdefault(component, doc)
    kept = collections.Counter((r.doc_id, r.text) for r in parity_join.one_of_each(edge).collect())
    words = [(i, t) for i, t in EDGE if (t or "").encode().split()]
    assert collections.Counter({k: n for k, n in kept.items() if not (k[1] or "").encode().split()}) == collections.Counter((i, t) for i, t in EDGE if not (t or "").encode().split())
    assert all(kept[k] <= 1 for k in words)
    assert {i for i, t in kept if (t or "").encode().split()} == {c for (_, n, c) in jaccard_brute(EDGE, 5, 80) if n}


def test_hamming_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[:280], rng.integers(0, 2**63, 15).astype(np.uint64)]))
        x, y = parity_join.size_sketch(a).view(np.uint64), parity_join.size_sketch(b).view(np.uint64)
        width = min(len(x), len(y))
        apart = np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, width)) ^ np.bitwise_xor.reduce(y.reshape(-1, width))).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_block():
    """Sets as different as links may be, of every size up to 300 and of sizes in neighbouring bands."""
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        for n in [*range(1, 300), 1023, 1500, 2047]:
            pool = np.unique(rng.integers(0, 2**64, 2 * n + 20, dtype=np.uint64))
            rng.shuffle(pool)
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            more = max(0, (100 * (n - gone)) // percent - n)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[gone:n], pool[n : n + more]]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            keys = [set().union(*(parity_join.block_keys(x, k, percent).tolist() for k in range(len(x).bit_length() - 1, (100 * len(x) // percent).bit_length()))) for x in (a, b)]
            assert keys[0] & keys[1], (percent, n, gone, more)
