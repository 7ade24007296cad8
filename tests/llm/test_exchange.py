"""Parts by relays reach the same places as directly, and their rows grow in proportion to the chunks."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exchange as ex
from quillspark.llm import ngrams, substrings, suffixes


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    passage = " ".join(f"p{r.randrange(99)}" for _ in range(80))
    out = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(90)))) for i in range(150)]
    return [(i, f"{t} {passage}" if i % 3 == 0 else t) for i, t in out] + [(None, None), (7, ""), (8, passage)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hops():
    assert [ex.Route(n, n, 4).hops for n in (1, 4, 5, 16, 17, 64, 65)] == [1, 1, 2, 2, 3, 3, 4]
    assert ex.Route(65, 3, 4).far == 64


def test_a_relay_gets_what_a_chunk_sends(docs, monkeypatch):
    """In chunks: a relay takes `fan` senders' rows, each for `far` of the buckets. One hop reaches 16 GB of text."""
    for fan in (3, 16, ex.FAN):
        monkeypatch.setattr(ex, "FAN", fan)
        for n in (fan + 1, 2 * fan, fan * fan // 2 + 1, fan * fan, fan**3 - 1):
            r = ex.Route(n, n, ex.even_fan(n))
            assert r.hops == ex.Route(n, n, fan).hops and r.fan <= fan
            assert r.fan * r.far / n <= 3
    monkeypatch.undo()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert ex.route(docs).fan == ex.even_fan(parts) and ex.Route(2048, 2048, ex.even_fan(2048)).hops == 1


@pytest.mark.parametrize("fan", [2, 3])
def test_relays_change_nothing(docs, rows, monkeypatch, fan):
    of = lambda: (read(suffixes.digests(docs)), read(substrings.digests(docs)), [(*x[:5], round(x[5], 6), round(x[6], 6)) for x in read(ngrams.scored(docs))])
    direct = of()
    monkeypatch.setattr(ex, "FAN", fan)
    assert ex.route(docs).hops > 1
    assert of() == direct
    assert direct[1] == sorted(plain.substring_dedup(rows), key=str)


def test_rows_grow_with_the_chunks(spark):
    """Three sizes, with partitions held: at most fan rows a chunk in each hop."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.hash(F.col("id"), k))).alias("text"))
    counts = []
    for n in (16, 64, 256):
        r = ex.Route(n, n, 4)
        chunks = ex.chunked(docs, n)
        asks = ex.chunk_asks(chunks, r, lambda c, t, r=r: substrings._ask_blocks(c, t, r.buckets))
        sent = [asks]
        for k in range(1, r.hops):
            sent.append(ex._relayed(sent[-1], [F.floor(F.col("c") / r.fan).alias("to"), "b"], r.fan**k, r.fan ** (r.hops - 1 - k)))
        counts.append([s.count() for s in sent])
        assert all(c <= r.fan * n for c in counts[-1]) and len(counts[-1]) == r.hops
    assert counts[2][0] <= 4.4 * counts[1][0] <= 4.4 * 4.4 * counts[0][0]
