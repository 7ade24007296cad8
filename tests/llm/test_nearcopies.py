"""Near copies against all pairs, at every similarity and for hard rows."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest

from quillspark.llm import nearcopies

SCHEMA = "doc_id long, text string"


def exact(rows):
    """(doc_id, component): all pairs compared, links at Jaccard 0.8 or more; rows of equal sets are one."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or (a and 5 * both >= 4 * (len(a) + len(sets[j]) - both)):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min((d for (d, _), x in zip(rows, root, strict=True) if x == r and d is not None), default=None) for r in root}
    return [(d, least[r]) for (d, _), r in zip(rows, root, strict=True)]


def edited(words, j, r):
    """A copy with one word in several replaced until its similarity is just under or over j."""
    out, have = list(words), {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for at in r.sample(range(len(words)), len(words)):
        was, out[at] = out[at], f"e{r.random()}"
        now = {tuple(out[i : i + 5]) for i in range(len(out) - 4)}
        if len(have & now) / len(have | now) < j:
            out[at] = was
            break
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = [(None, None), (900, ""), (901, " "), (902, "a b"), (903, "A  b"), (904, "a b c d e f g h"), (905, "a b c d e f g h i")]
    for k in range(240):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 150, 400]))]
        out += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, [0.6, 0.75, 0.8, 0.85, 0.9, 0.95][k % 6], r))]
    return [*out, (None, out[20][1]), (3, out[40][1])]


def test_every_pair_from_four_fifths_on(spark, rows):
    expected = sorted(exact(rows), key=str)
    docs = spark.createDataFrame(rows, SCHEMA)
    for size in (512, 1):  # gathered whole, or in blocks
        got = sorted(((r.doc_id, r.component_id) for r in nearcopies.grouped(docs, size=size).collect()), key=str)
        assert got == expected


def test_stage_drops_what_is_similar_only(spark, rows):
    """Copies at 0.8 to 0.95 go, those under 0.8 stay."""
    kept = {r.doc_id for r in cp.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {c for _, c in exact(rows)} | {None}


def test_common_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, 3000, dtype=np.uint64)) for _ in range(6)]
    every = np.arange(6)
    assert (nearcopies.common(sets, every, every)[~np.eye(6, dtype=bool)] == [len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j]).all()


def test_components_with_crowded_labels(spark, monkeypatch):
    """Stars, chains and loners, with every label crowded and with none; by the smallest node and by the smallest rank."""
    from quillspark.llm import components

    r = random.Random(3)
    edges = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    rank = {n: None if n % 7 == 0 else (n * 37) % 1000 for n in nodes}
    least = {}
    for n in nodes:
        least[root[n]] = min(least.get(root[n], (True, 0)), (rank[n] is None, rank[n] or 0))
    frame = spark.createDataFrame(edges, "a long, b long")
    ranks = spark.createDataFrame(list(rank.items()), "node long, rank long")
    for hot in (1, 1000):
        monkeypatch.setattr(components, "HOT", hot)
        assert {r.node: r.component for r in components.components(frame).collect()} == root
        assert {r.node: r["rank"] for r in components.components(frame, ranks).collect()} == {n: None if least[root[n]][0] else least[root[n]][1] for n in nodes}


def test_links_grow_with_a_group_not_with_its_square(spark):
    """A group of near copies in 3 and in 12 blocks: a link for each set, and one for each two blocks."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(120)]
    for blocks in (3, 12):
        rows = []
        for k in range(blocks * 8):
            w = list(words)
            w[r.randrange(120)] = f"x{k}"
            rows.append((k, " ".join(w), 1, blocks * 8))
        found = nearcopies._confirmed(spark.createDataFrame(rows, "fp long, text string, component long, n long"), 5, 8).collect()
        assert len(found) <= blocks * 8 + blocks * (blocks - 1) // 2
        root = {k: k for k, *_ in rows}
        for a, b in found:
            old, new = root[a], root[b]
            root = {k: new if x == old else x for k, x in root.items()}
        assert len(set(root.values())) == 1


def test_fingerprints_name_candidates(spark):
    """Without bands the BK-trees alone find copies of one changed word."""
    r = random.Random(8)
    words = [[f"w{r.randrange(9000)}" for _ in range(600)] for _ in range(10)]
    rows = [(2 * k, " ".join(w)) for k, w in enumerate(words)] + [(2 * k + 1, " ".join([*w[:-1], "else"])) for k, w in enumerate(words)]
    keyed = nearcopies._keyed(spark.createDataFrame([(i, i, x) for i, x in rows], "doc_id long, th long, text string"), 5)
    got = {r.doc_id: r.sim for r in keyed.collect()}
    near = {k for k in range(10) if ((got[2 * k] ^ got[2 * k + 1]) & (1 << 64) - 1).bit_count() <= nearcopies.RADIUS}
    node = {r.doc_id: r.fp for r in keyed.collect()}
    found = {r.node: r.component for r in nearcopies._candidates(keyed.drop("bands").withColumn("bands", nearcopies.F.expr("transform(sequence(1, 20), k -> xxhash64(fp, k))"))).collect()}
    assert len(near) > 3 and all(found[node[2 * k]] == found[node[2 * k + 1]] for k in near)


def test_components_compute_their_edges_once(spark):
    """Edges that a costly plan gives are not computed again for the other direction, nor for the links of thinned()."""
    from quillspark.llm import components

    rows = [(k, k % 5) for k in range(10, 90)] + [(k, k % 3 + 5) for k in range(10, 90)]
    for thin in (False, True):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        edges = spark.createDataFrame(rows, "a long, b long").mapInArrow(counted, "a long, b long")
        found = components.components(components.thinned(edges) if thin else edges)
        assert {r.component for r in found.collect()} == {0}
        assert seen.value == len(rows)
