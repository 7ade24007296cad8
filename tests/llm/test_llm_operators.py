"""The operators against plain restatements, over rows that are hard: nulls, empty and very long texts, ties,
repeated rows, empty tables and columns of clashing names."""

import random
import zlib

import numpy as np
import plain
import public_tokenizers as P
import pytest

from quillspark.llm import bpe, decontaminate, htmltext, ngrams, quality, queries, simhash, substrings, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, n_words string, score string"


def hard_texts(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeßé😀 A") for _ in range(r.randint(1, 7))).strip() or "x" for _ in range(80)]
    text = lambda k: r.choice([" ", "\n", "  ", "\t"]).join(r.choice(vocab) for _ in range(k))
    passage, long = text(60), text(6000)
    out = [None, "", " ", "\n", "one", "a b", "In " * 300, "x" * 1000, "x" * 1000, long, long + " tail", "The End."]
    for _ in range(n):
        kind = r.randint(0, 4)
        if kind == 0:
            out.append(text(r.randint(1, 12)))
        elif kind == 1:
            out.append(text(30) + " " + passage + " " + text(30))
        elif kind == 2 and len(out) > 12:
            near = (out[r.randint(9, len(out) - 1)] or "").split(" ")
            near[r.randrange(len(near))] = "edited"
            out.append(" ".join(near))
        elif kind == 3:
            out.append(out[r.randint(0, len(out) - 1)])
        else:
            out.append(text(r.randint(20, 200)))
    return out


def hard_rows():
    texts = hard_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (5, rows[20][1]), (20, rows[20][1]), (None, rows[21][1]), (None, None), (-3, rows[30][1])]


@pytest.fixture(scope="module")
def rows():
    return hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "c", "w", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, expected, *cols):
    got = [tuple(r[c] for c in cols) for r in found.collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_suffix_dedup(docs, rows, empty):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = plain.suffix_dedup(rows)
    assert any(e[2] for e in expected)
    same(suffixes.digests(docs), expected, *cols)
    same(suffixes.digests(docs, hot=0), expected, *cols)  # every anchor by its strings' own hashes
    assert suffixes.digests(empty).count() == 0
    kept = suffixes.removed(docs).collect()
    assert sorted(plain.sha(bytes(r.kept)) for r in kept) == sorted(e[4] for e in expected)
    assert all(r.n_bytes == len(r.kept) + sum(s.e - s.s for s in r.spans) for r in kept)


def test_substring_dedup(docs, rows, empty):
    expected = plain.substring_dedup(rows)
    assert any(e[2] for e in expected)
    same(substrings.digests(docs), expected, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert substrings.digests(empty).count() == 0
    kept = substrings.repeats(docs)
    assert set(kept.columns) == set(docs.columns) | {"n_removed"} - {"chunk"} or "text" in kept.columns
    by = {(r.doc_id, r.text) for r in kept.collect()}
    assert all((i, t) in by for (i, t), e in zip(rows, expected, strict=True) if e[2] == 0)


def test_simhash(docs, rows, empty):
    expected = plain.linked(rows, 3, 2)
    same(simhash.digests(docs), expected, "doc_id", "fingerprint", "component_id")
    assert simhash.digests(empty).count() == 0
    wide = [(i, c) for i, _, c in plain.linked(rows, 5, 6, 8)]
    for hot in (4096, 2, 1):  # shards in a tree, or in blocks
        same(simhash.grouped(docs, hot=hot), wide, "doc_id", "component_id")
    for hot in (1, 2):  # shards by names
        same(simhash.grouped(docs, shingle=3, radius=2, blocks=3, few=0, hot=hot), [(i, c) for i, _, c in expected], "doc_id", "component_id")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted({c for _, c in wide if c is not None})


def test_bk_tree_finds_all():
    r = random.Random(3)
    centre = r.getrandbits(64)
    values = [centre ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 6))) & (1 << 64) - 1 for _ in range(300)]
    tree = simhash.BKTree()
    for k, v in enumerate(values):
        assert sorted(tree.add(v, 3)) == [j for j in range(k) if (values[j] ^ v).bit_count() <= 3]


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "a b"), (10, "A b"), (3, None), (4, "..."), (5, "naïve ÉCOLE 42")]


def test_decontamination(spark, docs, rows, empty):
    more = [(1000, "zero one two three FOUR five six seven eight nine ten eleven twelve thirteen, end"), (1001, "a b"), (1002, "naïve ÉCOLE 42" + " w" * 70), (1003, "aa b"), (1004, "one two three four five six seven eight nine ten eleven twelve")]
    d = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(i, t, "z") for i, t in more], "doc_id long, text string, score string"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = plain.contamination([*rows, *more], ITEMS)
    assert sum(e[5] for e in expected) >= 3
    same(decontaminate.digests(d, bench), expected, *cols)
    blocks = decontaminate.matches(d, bench, block_bytes=20)  # one pass for each block of items
    assert sorted((r.n_words, sum(h.e - h.s for h in r.hits)) for r in blocks.collect()) == sorted((e[1], e[2]) for e in expected)
    assert decontaminate.digests(empty, bench).count() == 0
    assert decontaminate.judged(docs, bench.limit(0)).where("contaminated").count() == 0


def test_items_without_ids(spark, docs):
    """Items of a null id hit words and count as one, without a place in the list of ids."""
    passage = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, passage), (2, "other words"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, passage), ("b", passage), ("a", passage + " end"), ("c", None)], "item_id string, text string")
    for kwargs in ({}, {"block_bytes": 1, "passes": 2}):
        got = {r.doc_id: r for r in decontaminate.matches(docs, bench, **kwargs).collect()}
        assert got[1]["items"] == ["a", "b", None] and got[1]["hits"] == [(0, 20)] and got[2]["items"] == got[3]["items"] == []
    r = {r.doc_id: r for r in decontaminate.digests(docs, bench).collect()}[1]
    assert (r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (20, 3, plain.sha(b"a,b"), True)


def test_bpe(docs, rows, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    encoder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in rows:
        ids = encoder.encode_ordinary(t or "")
        expected.append((i, len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha((t or "").encode())))
    same(bpe.digests(docs, path, P.PATTERN), expected, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert bpe.digests(empty, path, P.PATTERN).count() == 0
    back = bpe.decode_frame(bpe.encode_frame(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)


def test_bpe_replay_when_a_merge_makes_a_lower_rank():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4, b"ab": 5, b"cab": 6}
    c = bpe.Codec({**ranks, **{bytes([x]): 100 + x for x in range(256) if bytes([x]) not in ranks}}, r".+")
    import tiktoken

    t = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        assert np.frombuffer(next(iter(c.encode([text]))), "<u4").tolist() == t.encode_ordinary(text), text


def test_quality(spark, docs, rows, empty):
    found = quality.rules(docs)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(found, [(i, *plain.base_quality(t)) for i, t in rows], *cols)
    assert found.where("base_failed and kept").count() == 0
    assert quality.rules(empty).count() == 0
    r = random.Random(2)
    words = ["the", "of", "and", "to", "in", "a", "is", "that", "house", "river", "stone", "light"]
    clean = [" ".join(r.choice(words) for _ in range(400)) + "." for _ in range(30)]
    junk = " ".join(r.choice(words) + "%%$" for _ in range(400))
    listed = " | ".join("".join(r.choice("bcdfgh") for _ in range(6)) for _ in range(400))
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*clean, junk, listed, "too short to tell, but ten words long at the least"])], "doc_id long, text string, lang string")
    kept = {x.doc_id: x.kept for x in quality.rules(d).collect()}
    assert all(kept[k] for k in range(30)) and not kept[30] and not kept[31] and kept[32]


def test_quality_verdicts_equal_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = [(-k, t, "en") for k, t in enumerate(hard_texts(8, 20), 1)] + [(-100, "“Curly” — quotes… ‘and’ dashes – " * 20, "en"), (-101, "Ελληνικά γράμματα " * 40, "el"), (-102, "the | " * 300, None)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    rows = sorted(quality.rules(docs).join(docs.select("doc_id", "text", "lang"), "doc_id").collect(), key=lambda r: r.doc_id)
    want = plain.quality_verdicts([(r.text, r.lang, r.base_failed) for r in rows], quality.COMMON)
    for r, (cd, wd, bad) in zip(rows, want, strict=True):
        assert (r.char_distance, r.word_distance) == pytest.approx((cd, wd), abs=1e-9) and r.kept == (not r.base_failed and not bad)
    assert any(not r.kept and not r.base_failed for r in rows)


def test_distance_is_a_metric_on_counts():
    p = np.array([[1, 1, 0], [0, 0, 5], [0, 0, 0]])
    assert quality.distance(p, np.array([2, 2, 0])).tolist() == pytest.approx([0, 1, 0])
    assert quality.distance(p, np.zeros(3)).tolist() == [0, 0, 0]


def toxic_rows():
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(1500):
        w = [r.choice(words) for _ in range(40)]
        bad = r.random() < 0.15
        if bad:
            w[r.randrange(40)] = r.choice(["vilest", "scumbag", "grimmlich", "grimmig", "grimmer"])
        rows.append((i, " ".join(w)))
        if r.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, docs, empty):
    rows, labels = toxic_rows()
    d = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, "vilest " + "w1 " * 5000)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in toxicity.digests(d, lab).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for i, x in found.items())
    truth = {i: any(s in t for s in ("vilest", "scumbag", "grimm")) for i, t in rows}
    out = [i for i, t in truth.items() if found[i].held_out]
    assert sum(found[i].predicted == truth[i] for i in out) >= 0.97 * len(out)
    assert found[5000].score == found[5001].score < 0.5 and found[5002].predicted == 1
    nothing = toxicity.digests(docs, lab.limit(0)).collect()
    assert {x.predicted for x in nothing} == {0}
    assert {x.predicted for x in toxicity.digests(docs, lab.where("toxic = 0")).collect()} == {0}
    assert toxicity.digests(empty, lab).count() == 0


def test_toxicity_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = toxic_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kind = "doc_id long, quality int, toxic int"
    turned = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    a, b = (toxicity.digests(d, spark.createDataFrame(x, kind)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_ngram_scores(docs, rows, empty):
    import collections
    import math

    tokens = [plain.WORD.findall((t or "").translate(plain.UP)) + [None] for _, t in rows]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c, pair = collections.Counter(), collections.Counter()
    for w, held in zip(tokens, out, strict=True):
        if not held:
            c.update(w)
            pair.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    context, rest, follows = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), k in pair.items():
        context[a] += k
        rest[a][min(k, 3) - 1] += 1
        follows[b] += 1
    count = lambda x, k: sum(1 for y in x.values() if y == k)
    d, m = ngrams.discounts(*(count(pair, k) for k in (1, 2, 3, 4))), ngrams.discounts(*(count(follows, k) for k in (1, 2, 3, 4)))
    left = (m[1] * count(follows, 1) + m[2] * count(follows, 2) + m[3] * sum(1 for y in follows.values() if y > 2)) / sum(follows.values())
    lower = lambda w: max(follows[w] - m[min(follows[w], 3)], 0) / sum(follows.values()) + left / (v + 1)

    def p(a, w):
        if not context[a]:
            return lower(w)
        k = pair[a, w]
        return max(k - d[min(k, 3)], 0) / context[a] + sum(x * y for x, y in zip(d[1:], rest[a], strict=True)) / context[a] * lower(w)

    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in ngrams.scored(docs).collect()))
    want = sorted((i is not None, i or 0, held, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5), round(sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w[:-1]], w, strict=True)), 5)) for (i, _), w, held in zip(rows, tokens, out, strict=True))
    assert got == want
    assert ngrams.scored(empty).count() == 0
    assert math.isclose(sum(p("a", w) for w in c) + p("a", "\0"), 1.0, rel_tol=1e-9)


def test_shards_look_up_by_binary_search(tmp_path):
    keys = np.array([3, 9, 2**63 + 5], dtype=np.uint64)
    for folder in (None, str(tmp_path)):
        shard = ngrams.Shard(keys, [np.array([1, 2, 3]), np.array([0, 2**40, 7])], folder)
        found = shard.find(np.array([9, 4, 2**63 + 5, 2**64 - 1], dtype=np.uint64))
        assert [f.tolist() for f in found] == [[2, 0, 3, 0], [2**40, 0, 7, 0]]
    assert not list(tmp_path.iterdir())
    assert ngrams.Shard(keys[:0], [keys[:0]], None).find(keys)[0].tolist() == [0, 0, 0]
    assert [ngrams.mounted(x) for x in ("file:///a/b", "file:/a", "/a", "hdfs://h/a")] == ["/a/b", "/a", "/a", None]


PAGES = "page_id long, url string, html string, payload string, text string"


def pages(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://www.a.com/b?c=1", big), (7, "https://a.com:8080/b", big), (3, "http://a.com/b", big), (2, None, "small"), (4, "http://b.org/ x", "small"), (5, "bad://[url", None), (6, "http://é.fr/", "<p>é\r\n\r\nWARC/1.1\r\n" * 200), (7, "https://a.com:8080/b", big), (None, "http://n.com", big), (8, "", "")]
    return spark.createDataFrame([(*r, "p", "t") for r in rows], PAGES), rows


def test_warc(spark):
    import hashlib

    df, rows = pages(spark)
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in top and i != top[h]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    same(warc.digests(df), want, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    index = warc.histories(df).collect()
    order = [(r.urlkey, r.ts, r.page_id is not None, r.page_id or 0) for r in sorted(index, key=lambda r: (r.shard, r.position))]
    assert order == sorted(order) and len(order) == len(rows)
    assert warc.digests(spark.createDataFrame([], PAGES)).count() == 0


def test_loser_tree_merges():
    r = random.Random(1)
    for n in range(0, 9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(n)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_records_that_lie_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab"
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab"
    with pytest.raises(ValueError):
        list(warc.captures(good.replace(b"40", str(len(block)).encode()) + b"\r\n\r\n", "f"))
    with pytest.raises(ValueError):
        list(warc.parse(good))


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a> Slogan of ours</header>
<nav><ul><li><a href=x>Menu</a></li><li><a href=y>More</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to serve you better than ever before</div>
<div id="content"><article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> and&nbsp;a <a href=z>link</a> that goes on for a while.<p>Second one, unclosed.<br>After a break.
<div class="ad">Buy this now, it is very cheap and very good indeed</div><script>var a = "<p>no</p>";</script><!-- <p>no</p> --><form><label>Name</label><input></form>
<p>Third.</p></article></div><aside><p>Side words that nobody reads in this place at all</p></aside><section class="comments"><p>I liked this article very much and want to say so here.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_html(spark):
    want = "Title & more\n\nFirst paragraph with bold and a link that goes on for a while.\n\nSecond one, unclosed. After a break.\n\nThird."
    assert htmltext.main_text(HTML) == want
    for odd in (None, "", "<", "<p", "</p></div>", "<!--", "<a href='", "&amp;", "<p>" * 5000 + "x", "<div " * 3000, "<script>never closed"):
        assert isinstance(htmltext.main_text(odd), str)
    assert htmltext.main_text("<article>" + "<p>word</p>" * 30_000 + "</article>").count("word") == 30_000
    df = spark.createDataFrame([(1, "u", HTML, "x", "y"), (1, "u", HTML, "x", "y"), (2, None, None, "x", "y")], "page_id long, url string, html string, text string, n_chars string")
    got = htmltext.extract(df).collect()
    assert [r.text for r in got] == [want, want, ""] and [r.n_chars for r in got] == [len(want), len(want), 0]
    assert htmltext.digests(df.limit(0)).count() == 0


def test_queries_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
