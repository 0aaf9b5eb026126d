"""Operators 11 to 13 against brute force, on edge cases and on sf0.001."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import pytest
from pyspark.sql import types as T

from lexspark.llm import alignment, filter_audit, url_filter
from lexspark.llm.queries import BYTE_BPE, PIECES, tokenizer_path
from tests.llm.test_operators import EDGE, WORD

NAMED = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in ("doc_id", "text", "lang", "print", "mask", "part", "first", "block", "of")])
MANY = " ".join(f"w{i}" for i in range(120))
ROWS = [(i, t, "en") for i, t in EDGE] + [
    (20, MANY, "de"), (21, MANY, "de"), (22, MANY, ""), (22, MANY, None), (19, MANY, "de"), (None, MANY, "de"), (23, MANY + " $", "de"), (24, MANY.upper(), "fr"), (25, "a b " * 80, "fr"), (26, "", "fr"), (27, None, "fr"), (30, "dup\u00a0" * 100, "de"),
]
LABELS = [(20, 1, 0), (20, 0, 1), (21, 0, 1), (22, 1, None), (None, 1, 1), (99, 1, 1), (24, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, *"xyzuvw") for i, t, lang in rows], NAMED).repartition(3)


def audit_brute(rows, labels):
    def mask(i, t):
        t = t or ""
        w = WORD.findall(t)
        later = i is not None and any(j is not None and j < i and (s or "") == t for j, s, _ in rows)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), later)
        return {f for f, failed in zip("ABCDE", tests) if failed}

    said = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    parts = collections.defaultdict(list)
    for i, t, lang in rows:
        parts[lang or ""].append((mask(i, t), said(i, 1), said(i, 2)))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                redundant = sum(f in d[0] for d in docs) - len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
        out = {k: (*v, shapley[k[1][k[2] - 1]]) if k[0] == part else v for k, v in out.items()}
    return out


def test_filter_audit(spark, sf_dir):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit_filters(frame(spark, ROWS), labels).collect()]
    assert {r[:3]: r[3:] for r in got} == audit_brute(ROWS, LABELS) and len(got) == 4 * 600
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = [tuple(r) for r in filter_audit.audit_filters(docs, labels).collect()]
    assert {r[:3]: r[3:] for r in got} == audit_brute(rows, [tuple(r) for r in labels.collect()])
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_filters(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_orders_follow_by_one_swap_each():
    for n in range(1, 7):
        orders = list(filter_audit.plain_changes(n))
        assert len({o for o, _ in orders}) == len(orders) == len(list(itertools.permutations(range(n))))
        for (a, _), (b, low) in itertools.pairwise(orders):
            assert b == (*a[:low], a[low + 1], a[low], *a[low + 2 :])


URLS = [
    None, "", "no address", "http://", "http://EXAMPLE.org/en/12?x=/es/", "https://blog.Example.Org/es/9#top", "http://badexample.org/es/1", "http://example.org", "http://a.com/fr/1;k", "http://a.com/FR/1", "https://com/de/",
    "x://y://z.org/es/1", "http://user@h.org:80/a?b=c&d#e", "http://h.net?x=1", "http://h.net#x/y", "http://\u0130.ORG/ß/1", "http://a.com/de/" + "9" * 5000, "http://h.net/de/1", "http://h.net/de/1",
]


def url_brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r.text for r in url_filter.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    edge = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(URLS)] + [(None, "http://a.org/x", "h", "p")], "page_id long, url string, host string, rule string")
    verdict = {r.text: r.verdict for r in url_filter.RULES}
    for table in (edge, pages.unionByName(edge.selectExpr("page_id + 1000000 as page_id", "url"), allowMissingColumns=True)):
        rows = collections.Counter((r.page_id, r.url) for r in table.collect())
        got = url_filter.judge_urls(table).collect()
        urls = dict(rows.keys())
        assert len(got) == sum(rows.values())
        same = collections.defaultdict(set)
        for r in got:
            assert (r.host, r.path, r.rule) == url_brute(urls[r.page_id])
            assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdict[r.rule])
            same[urls[r.page_id]].add(r.verdict)
        assert all(len(v) == 1 for v in same.values())
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [url_filter.Rule("block", "org", "/")]).collect()} == {"block"}
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_url_trees_find_blocked_urls_that_no_rule_names(spark):
    """Junk below one half of the hosts is blocked by name; below the other half the trees have to find it."""
    url = "case when id % 3 = 0 then concat('http://x', h, '.test/', id * 7919 % 100000000, '-', id * 104729 % 99991, '?a=', id, '&b=1&c=2') else concat('https://site', h, '.test/news/', element_at(array('city', 'sport', 'people'), cast(1 + id % 7 % 3 as int)), '/story.html') end"
    pages = spark.range(3000).selectExpr("id", "id % 40 as h").selectExpr("id as page_id", f"{url} as url")
    rules = [url_filter.Rule("block" if kind == "x" else "allow", f"{kind}{h}.test", "/") for h in range(20) for kind in ("x", "site")]
    rows = url_filter.judge_urls(pages, rules, trees=5, depth=3).where("rule is null").collect()
    right = [(r.verdict == "block") == r.host.startswith("x") for r in rows]
    assert len(rows) == 1500 and sum(right) / len(right) > 0.95


def test_url_filter_is_native(spark, sf_dir):
    plan = url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def alignment_brute(docs):
    own = alignment.Aligner(tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))
    rows, links = [], []
    for i, t in docs:
        data = b" " + (t or "").encode()
        a = own.a.encode(" " + (t or ""), add_special_tokens=False).ids
        b = own.b.encode(t or "")
        if not t or b"".join(own.a_bytes[x] for x in a) != data or b"".join(own.b_bytes[x] for x in b) != data:
            rows.append((i, 0, 0, 0, "", collections.Counter()))
            continue
        ends = lambda ids, table: list(itertools.accumulate(len(table[x]) for x in ids))
        ea, eb = ends(a, own.a_bytes), ends(b, own.b_bytes)
        common = sorted(set(ea) & set(eb))
        at_a, at_b, groups = 0, 0, []
        for c in common:
            na, nb = ea.index(c, at_a) + 1, eb.index(c, at_b) + 1
            groups.append((a[at_a:na], b[at_b:nb]))
            at_a, at_b = na, nb
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((i, len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest(), collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = collections.Counter(p for r in rows for p in r[5])
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for i, na, nb, ng, sha, own_links in rows:
        links.append((i, na, nb, ng, sum(own_links.values()), sum(n for p, n in own_links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own_links.items()), sha))
    return collections.Counter(links)


ODD = ["<s> </s><unk> <0x41><0x0A> <|endoftext|>", "a\u2581b", "\u2581", "x  y\t\tz \n\n w", " lead", "trail ", "\n", "naïve 中文字符 ☃🙂 e\u0301", "a\u00a0b \u2003c", "\u2581 well known words", "don't I'll we've", "\x00\x01 ok", "1234567 89,000.5", "ﬁ ① Å", "x" * 300]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 500])
def test_alignment(spark, sf_dir, block_bytes):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for docs in (frame(spark, [*((i, t, "en") for i, t in EDGE), *((100 + k, t, "en") for k, t in enumerate(ODD))]), documents):
        got = alignment.alignment_digests(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECES), block_bytes).collect()
        assert collections.Counter(tuple(r) for r in got) == alignment_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.alignment_digests(documents.limit(0), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES)).count() == 0


def test_alignment_groups(spark):
    own = alignment.Aligner(tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))
    rows = alignment.align_tokens(frame(spark, [(1, "unbelievable tokenizers", "en"), (2, None, "en")]), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES)).collect()
    assert [r.groups for r in rows if r.doc_id == 2] == [""]
    (row,) = [r for r in rows if r.doc_id == 1]
    a_text, b_text = b"", b""
    for group in row.groups.split(";"):
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        a_text, b_text = a_text + b"".join(own.a_bytes[x] for x in a), b_text + b"".join(own.b_bytes[x] for x in b)
        assert a_text == b_text
    assert a_text == b" unbelievable tokenizers" and row.n_groups == row.groups.count(";") + 1
