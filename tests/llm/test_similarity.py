"""Near duplicates and embeddings against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from boursecraft.llm import components, embeddings, near_dedup
from boursecraft.llm.near_dedup import Sampler, Weights, shingles, weighted_jaccard
from boursecraft.session import tables_dir


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_random_links(spark):
    random.seed(1)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    pairs = [p for p in pairs if None not in p and p[0] != p[1]]
    assert found == roots({x for p in pairs for x in p}, pairs)


def test_few_links_are_joined_by_one_task_and_many_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(90)] + [(7, 7), (None, 3)]
    links = spark.createDataFrame(pairs, "a long, b long")
    pairs = [p for p in pairs if None not in p and p[0] != p[1]]
    want, jobs = roots({x for p in pairs for x in p}, pairs), []
    run = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for once in (1 << 21, 0):
        monkeypatch.setattr(components, "ONCE", once)
        before = run()
        assert {r.id: r.component for r in components.components(links).collect()} == want
        jobs.append(run() - before)
    assert jobs[0] < jobs[1] / 2
    named = components.components(links.selectExpr("CAST(a AS STRING) AS a", "CAST(b AS STRING) AS b"))  # other types go in rounds
    assert {r.id for r in named.collect()} == {str(i) for i in want}
    assert components.components(links.limit(0)).count() == 0


def test_rounds_of_components_leave_one_table(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    links = lambda: {f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().startswith("links-")} if files.exists(folder) else set()
    before = links()
    found = components.components(chain)
    assert {r.component for r in found.collect()} == {0}
    assert len(links() - before) == 1


def test_sampling_agrees_with_the_weighted_similarity():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(600)]
    base = [words[i] for i in rng.integers(0, 600, 400)]
    other = base[:330] + [words[i] for i in rng.integers(0, 600, 70)] + base[:60]
    a, b, plain = " ".join(base), " ".join(other), Weights({})
    sampler = Sampler(samples=3000)
    draws = [sampler.draw(h, plain.of(h, n)) for h, n in (shingles(a), shingles(b))]
    assert abs((draws[0] == draws[1]).mean() - weighted_jaccard(a, b, plain)) < 0.04


def test_groups_equal_brute_force(spark, awkward, nothing):
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(random.randint(3, 90))]
        for _ in range(random.randint(1, 12)):
            copy = [word() if random.random() < 0.015 else w for w in base]
            rows.append((i, " ".join(copy + (passage if random.random() < 0.4 else []))))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = Weights(near_dedup.common_shingles(near_dedup._texts(docs, "doc_id", "text")))
    pairs = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if weighted_jaccard(x, y, weights) >= 0.8]
    want = roots([r[0] for r in rows], pairs)
    assert {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()} == want
    kept = near_dedup.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == set(want.values())

    found = near_dedup.near_duplicates(awkward).collect()
    groups = {r.doc_id: r.group_id for r in found if r.doc_id is not None}
    assert len(found) == awkward.count()
    assert groups[2] == 1 and groups[8] == 7 and groups[12] == 11 and groups[6] == 5 and groups[3] == 3 and groups[10] == 10
    assert near_dedup.keep_one(awkward).columns == awkward.columns
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_every_pair_of_two_components_is_a_candidate():
    marks = np.arange(4 * 48).reshape(4, 48).astype(np.uint8)
    marks[2, :40] = marks[0, :40]  # the pair that agrees most
    marks[3, :38] = marks[1, :38]
    block = pa.RecordBatch.from_arrays(
        [*(pa.array([0] * 4, pa.int64()) for _ in range(4)), pa.array([1, 2, 3, 4]), pa.array([1, 1, 3, 3]), pa.array([m.tobytes() for m in marks])],
        ["band", "part_a", "part_b", "side", "rep", "kind", "samples"],
    )
    found = {tuple(sorted(r.values())) for out in near_dedup._candidates(True)([block]) for r in out.to_pylist()}
    assert found == {(1, 3), (2, 4)}


def test_shingles_of_a_block_equal_those_of_each_text(awkward):
    rng = random.Random(2)
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e f", "  ", "Ünï 😀 x y z w", "w" * 3000 + " a b c d"] + [" ".join(rng.choice("abc") * rng.randrange(1, 20) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    texts += [r.text or "" for r in awkward.collect()] + ["ΣΑΣ Σ", "İstanbul İ", "ªº²½٣ॐ_ a\u0301b", "a\nb\r\nc\x1cd", "_", "漢字 かな ﾊﾝｶｸ x y", "𝐀𝐁 😀😀 ok"]
    for text, (h, n) in zip(texts, near_dedup.block_shingles(texts)):
        want = shingles(text)
        assert h.tolist() == want[0].tolist() and n.tolist() == want[1].tolist()
    assert near_dedup.block_shingles([]) == []


def test_a_band_with_one_large_component_stays_linear(spark):
    rows = spark.range(20000).selectExpr("id AS rep", "1 AS band", "CASE WHEN id < 19990 THEN 0 ELSE id END AS kind")
    dealt = near_dedup._blocked(rows, "band", ["rep", "kind"])
    assert dealt.count() < 1.1 * 20000  # it was 800,000
    # every pair of different kinds meets in exactly one pair of blocks, or within one block
    small = spark.range(1500).selectExpr("id AS rep", "1 AS band", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS kind")
    seen = {}
    for r in near_dedup._blocked(small, "band", ["rep", "kind"]).collect():
        seen.setdefault((r.part_a, r.part_b), ([], []))[r.side].append((r.rep, r.kind))
    pairs = set()
    for (a, b), (left, right) in seen.items():
        for x, kx in left:
            for y, ky in left if a == b else right:
                if kx != ky and (a != b or x < y):
                    pair = (min(x, y), max(x, y))
                    assert pair not in pairs
                    pairs.add(pair)
    kinds = [0 if k % 3 == 0 else k for k in range(1500)]
    assert len(pairs) == sum(kinds[x] != kinds[y] for x in range(1500) for y in range(x))


def test_few_equal_samples_do_not_drop_a_pair_of_a_band():
    marks = np.arange(2 * 48).reshape(2, 48).astype(np.uint8)
    marks[1, :24] = marks[0, :24]
    block = pa.RecordBatch.from_arrays(
        [*(pa.array([0] * 2, pa.int64()) for _ in range(4)), pa.array([1, 2]), pa.array([1, 2]), pa.array([m.tobytes() for m in marks])],
        ["band", "part_a", "part_b", "side", "rep", "kind", "samples"],
    )
    for rows in (False, True):
        assert [r for out in near_dedup._candidates(rows)([block]) for r in out.to_pylist()] in ([{"a": 1, "b": 2}], [{"a": 2, "b": 1}])


def test_variants_around_the_threshold_equal_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(600)]
    for _ in range(8):
        base = [word() for _ in range(120)]
        for _ in range(40):
            copy = list(base)
            for k in rng.sample(range(120), rng.randint(1, 4)):
                copy[k] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = Weights(near_dedup.common_shingles(near_dedup._texts(docs, "doc_id", "text")))
    every = [near_dedup._leveled(t, weights) for t in texts]
    like = near_dedup.similarities(every, every)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(like >= 0.8)) if a < b]
    want = roots(range(len(texts)), pairs)
    assert {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()} == want


def test_texts_without_company_are_not_read_for_every_step(spark):
    made, rng = spark.sparkContext.accumulator(0), random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(30)) for _ in range(80)]
    texts += [texts[0] + " and a tail", texts[1] + " and another tail"]

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    groups = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()}
    assert groups == {i: {80: 0, 81: 1}.get(i, i) for i in range(82)}
    # names and counts of common shingles, number of rows, signatures, texts to compare, rows without identifier; it was 11 times
    assert made.value <= 6 * len(texts)


def test_similarities_within_a_block_equal_those_of_two(awkward):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [r.text or "" for r in awkward.collect()]
    every = [near_dedup._leveled(t, Weights({})) for t in texts]
    one, two = near_dedup.similarities(every), near_dedup.similarities(every, every)
    apart = ~np.eye(len(every), dtype=bool)
    assert np.allclose(one[apart], two[apart], rtol=0, atol=1e-12)
    for k in range(0, len(texts), 7):
        assert all(abs(one[k, m] - weighted_jaccard(texts[k], texts[m], Weights({}))) < 1e-9 for m in range(len(texts)) if m != k)


def test_frequencies_of_common_shingles_are_exact(spark):
    rows = [(i, " ".join(["alpha beta gamma delta epsilon"] * (i % 3 > 0)) + f" n{i} m{i} o{i} p{i} q{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(7)
    found = near_dedup.common_shingles(docs)
    h = int(shingles("alpha beta gamma delta epsilon")[0][0])
    assert set(found) == {h} and abs(found[h] - max(0.5, np.log(90 / 60) / np.log(20))) < 1e-9


def brute_links(rows, cosine):
    usable = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float)
        usable[k] = (i, v / np.linalg.norm(v), label)
    pairs = [(m, n) for m, a in usable.items() for n, b in usable.items() if m < n and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= cosine]
    count = [0] * len(rows)
    for m, n in pairs:
        count[m], count[n] = count[m] + 1, count[n] + 1
    root = roots([r[0] for r in rows if r[0] is not None], [(rows[m][0], rows[n][0]) for m, n in pairs])
    return sorted(((r[0], c, root.get(r[0]), r[0] is None or root[r[0]] == r[0]) for r, c in zip(rows, count)), key=repr)


def found_links(table, **kw):
    return sorted((tuple(r) for r in embeddings.links(table, 0.93, **kw).collect()), key=repr)


def test_an_identifier_on_several_vectors_joins_what_they_reach(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, a, 1), (5, a, 1), (5, b, 1), (6, b, 1), (7, b, 1), (8, [0.0, 0.0, 1.0], 1), (8, None, 1), (9, a, 2), (9, b, 2), (9, b, 2), (10, None, 1), (10, [0.0] * 3, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = found_links(table)
    assert found == brute_links(rows, 0.93)
    assert {i for i, _, c, _ in found if c == 0} == {0, 5, 6, 7}


def test_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for label in (0, 1, 1, 1):
        for _ in range(12):
            centre = rng.normal(size=8)
            for _ in range(rng.integers(1, 14)):
                rows.append((i, [float(x) for x in (centre + rng.normal(size=8) * 0.25).astype(np.float32)], label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, None, 0), (i + 3, [0.0] * 8, 0), (i + 4, [1.0, None] * 4, 0), (i + 5, [float("nan")] * 8, 0), (i + 6, rows[0][1], None), (i + 7, [], 1), (i + 8, [1.0, 2.0], 0), (i + 9, [float("inf")] * 8, 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, point int")
    rows += [(int(rng.integers(0, i)), rows[int(rng.integers(0, i))][1], 1) for _ in range(15)]  # identifiers and vectors that come again
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, point int")
    want = brute_links(rows, 0.93)
    for cell, block, part in ((8192, 2048, 8192), (20, 9, 8192), (20, 9, 30)):
        monkeypatch.setattr(embeddings, "CELL", cell)
        monkeypatch.setattr(embeddings, "SLICE", part)
        assert found_links(table, block=block) == want
    assert embeddings.links(table.limit(0), 0.93).count() == 0


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    points = np.repeat(rng.normal(size=(40, 3)), 20, 0) + rng.normal(size=(800, 3)) * 0.01
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = embeddings.CoverTree(points)
    for centre, radius, members in zip(tree.centre, tree.radius, tree.members):
        assert (np.linalg.norm(points[members] - points[centre], axis=1) <= radius + 1e-9).all()
    looked = sum(len(a) * len(b) for a, b in embeddings.dual_pairs(tree, tree, 0.05))
    assert looked < 800 * 800 / 8
