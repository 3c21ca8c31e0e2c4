"""Similarity joins, near vectors, the language model, mixing, and the pipeline, against brute force."""

import collections
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import common, components, jaccard, mixing, near_vectors, ngram_lm, queries
from loomwork.llm.words import word_hashes
from tests.conftest import rows
from tests.llm.test_texts import awkward, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def least(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(table, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in table if i is not None]
    held = collections.defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            held[x].add(k)
    pairs = {(a, b) for ks in held.values() for a in ks for b in ks if a < b}
    links = [(sets[a][0], sets[b][0]) for a, b in pairs if den * len(sets[a][1] & sets[b][1]) >= num * len(sets[a][1] | sets[b][1])]
    return least(links, {i for i, _ in sets})


def check_join(df, n, num, den):
    table = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(table, n, num, den)
    got = jaccard.link_texts(df, words=n, num=num, den=den).collect()
    assert len(got) == len(table)
    assert sorted((repr(r.doc_id), r.n_shingles) for r in got) == sorted((repr(i), len(shingles(t, n))) for i, t in table)
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_join_matches_brute_force(spark, sf_dir, n, num, den):
    check_join(documents(spark, sf_dir), n, num, den)


def test_join_of_odd_rows(spark):
    check_join(awkward(spark), 3, 90, 100)
    assert jaccard.link_texts(empty(spark)).count() == 0


def test_join_of_large_groups(spark, monkeypatch):
    """Copies, near copies that link and near copies that just miss; small blocks and short lists, so all paths are taken."""
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PREFIXES", 16)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(80)]
    table = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 90):
        w = list(base)
        for at in rng.choice(80, size=int(rng.integers(1, 4)), replace=False):
            w[at] = f"own{i}" if rng.random() < 0.5 else f"shared{int(rng.integers(4))}"
        table.append((i, " ".join(w)))
    table += [(i, " ".join(rng.permutation(base)[: int(rng.integers(1, 12))])) for i in range(90, 140)]
    df = spark.createDataFrame([(int(i), t) for i, t in table], "doc_id long, text string").repartition(4)
    check_join(df, 3, 90, 100)
    check_join(df, 5, 80, 100)


def test_blocks_take_little_more_than_their_result():
    rng = np.random.default_rng(3)
    row, h = np.repeat(np.arange(1_500), 40), rng.integers(0, 9_000, 60_000).astype(np.uint64)
    row, h = np.unique(np.stack((row, h)), axis=1).astype(np.int64)
    tracemalloc.start()
    common = jaccard._in_common(row, h.view(np.uint64), 1_500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sets = [set(h[row == i].tolist()) for i in range(1_500)]
    assert all(common[i, j] == len(sets[i] & sets[j]) for i in range(0, 1_500, 41) for j in range(0, 1_500, 7) if i != j)
    assert peak < 3 * 4 * 1_500**2  # the result has four bytes a pair


def test_words_of_many_texts_take_the_room_of_a_part():
    texts = pa.array(["Ab c", None, "", "x" * 900_000] + [f"word{i} Other{i % 5}  end" for i in range(250_000)] + ["ab C"])
    alone = [word_hashes(pa.array([t]))[0].tolist() for t in ("ab c", "word0 other0 end", "x" * 900_000)]
    tracemalloc.start()
    h, bounds = word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [h[bounds[i] : bounds[i + 1]].tolist() for i in (0, 4, 3, len(texts) - 1)] == [*alone[:1], *alone[1:], *alone[:1]]
    assert bounds[:4].tolist() == [0, 2, 2, 2] and len(bounds) == len(texts) + 1 and bounds[-1] == len(h)
    assert peak < 90e6  # 300 MB if all were hashed at once


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    table = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, "other words here", "c"), (None, text, "d"), (None, None, "e"), (8, None, "f")]
    df = spark.createDataFrame(table, "doc_id long, text string, x string")
    assert sorted(r.x for r in jaccard.one_of_each(df).collect()) == ["b", "c", "d", "e", "f"] and jaccard.one_of_each(df).columns == df.columns
    clash = df.withColumns({"row_of_id": F.lit("mine"), "m": F.create_map(F.lit("k"), F.col("x")), "component_id": F.lit(-1)})
    kept = jaccard.one_of_each(clash)
    assert kept.columns == clash.columns and sorted((r.x, r.row_of_id, r.m["k"], r.component_id) for r in kept.collect()) == [(x, "mine", x, -1) for x in "bcdef"]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 12), (12, 11), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    want = {i: c for i, c in least(edges, {x for e in edges for x in e}).items() if i != c}
    assert got == want


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([centres[rng.integers(40, size=500)] + rng.normal(size=(500, 24)) * 0.15, np.repeat(centres[:1], 90, 0) + rng.normal(size=(90, 24)) * 0.02, centres[:3], centres[:3]])
    table = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    table += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [1.0, None]), (1005, [float("inf"), 1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("links", F.lit(1))
    got = {r.vec_id: r for r in near_vectors.link_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = least([(int(a), int(b)) for a, b in zip(*np.nonzero(near))], range(len(x)))
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x))) and found >= 0.97 * near.sum()
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) >= 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006))
    assert got[None].n_links == 0 and got[None].component_id is None and len(got) == len(table)
    assert near_vectors.link_vectors(df.where("false")).count() == 0


def test_large_leaves_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = np.ones((100, 16)) + rng.normal(size=(100, 16)) * 0.01
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = near_vectors.link_vectors(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)} and sum(r.kept for r in got) == 1


def test_leaves_beyond_the_sample_are_split_further(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SAMPLE", 256)
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(2000, 48))
    x = np.concatenate([centres, centres + rng.normal(size=centres.shape) * 0.12, centres[:1] + rng.normal(size=(300, 48)) * 0.05])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors.link_vectors(df).collect()}
    assert all(got[i] <= near[i].sum() for i in range(len(x))) and sum(got.values()) >= 0.97 * near.sum()
    # without the tight group, the leaves of a forest of 256 vectors are of bounded size, of 4,000 as of 16,000
    for many in (4_000, 16_000):
        more = rng.normal(size=(many, 48))
        more /= np.linalg.norm(more, axis=1, keepdims=True)
        forest = near_vectors.fit_forest(more[:256], many, 0.95)
        codes, n = np.unique(np.concatenate([c for _, c in forest.leaves(more)]), return_counts=True)
        assert n.max() > many / 64 and forest.deepen(dict(zip(codes[n > 64].tolist(), n[n > 64].tolist())), 64)
        _, n = np.unique(np.concatenate([c for _, c in forest.leaves(more)]), return_counts=True)
        assert np.percentile(n, 90) < 2 * 64  # twice the aim, at both sizes


@pytest.mark.parametrize("part", [8192, 128])
def test_vectors_are_routed_in_small_batches(spark, monkeypatch, part):
    """A vector has tens of leaves, more in a larger table, so its copies for them must not be made for thousands of vectors at once."""
    monkeypatch.setattr(near_vectors, "PART", part, raising=False)
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2800, 64))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.1, x[:1] + rng.normal(size=(400, 64)) * 0.05]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)

    def checked(df, function, *more, to=type(spark.range(1)).mapInArrow):
        def run(batches):
            for batch in function(batches):
                assert batch.nbytes < 8 << 20, f"a batch of {batch.nbytes >> 20} MB"
                yield batch

        return to(df, run, *more)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", checked)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.link_vectors(df).collect()}
    want = least([(int(a), int(b)) for a, b in zip(*np.nonzero(near))], range(len(x)))
    assert all(got[i][0] <= near[i].sum() for i in range(len(x))) and sum(n for n, _ in got.values()) >= 0.97 * near.sum()
    assert np.mean([got[i][1] == want[i] for i in range(len(x))]) >= 0.97


def test_vectors_that_share_an_id(spark):
    x = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0]}
    table = [(1, x["a"]), (1, x["b"]), (2, [1.0, 0.01, 0.0]), (3, [0.01, 1.0, 0.0]), (4, [0.0, 1.0, 0.01])]
    got = near_vectors.link_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_lm_without_rows_or_training_texts(spark):
    assert ngram_lm.score_texts(empty(spark), F.lit(ngram_lm.ESTIMATE)).count() == 0
    nothing = ngram_lm.score_texts(awkward(spark), F.lit(ngram_lm.UNSEEN)).collect()
    assert len(nothing) == awkward(spark).count() and all(r.n_known == 0 and r.base_score == 0 and np.isfinite(r.score) for r in nothing)


@pytest.mark.parametrize("coded,frequent", [(40, 1 << 20), (40, 100), (ngram_lm.CODED, 1 << 20), (ngram_lm.CODED, 50)])
def test_lm_keeps_the_counts_of_every_word(spark, sf_dir, monkeypatch, coded, frequent):
    """Words without a code keep their own bigrams, as contexts and as predicted words, over several buckets."""
    monkeypatch.setattr(ngram_lm, "KEYS_A_BUCKET", 4_000)
    monkeypatch.setattr(ngram_lm, "PAIRS", frequent)
    docs = documents(spark, sf_dir).select("doc_id", "text").union(awkward(spark).where("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    tenth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    part = F.when(tenth == 0, ngram_lm.UNSEEN).when(tenth == 9, ngram_lm.HELD).otherwise(ngram_lm.ESTIMATE)
    kept = {}
    real, learn = ngram_lm._scored, ngram_lm.learn_weights

    def spy(texts, model, *rest):
        kept["model"] = model
        return real(texts, model, *rest)

    def events(pairs, n):
        kept["events"] = [tuple(np.frombuffer(v, k) for v, k in zip(r, (np.uint8, float, float, np.int64))) for r in pairs.where("kind = 0").select("b", "f12", "f1", "n").collect()]
        return learn(pairs, n)

    monkeypatch.setattr(ngram_lm, "_scored", spy)
    monkeypatch.setattr(ngram_lm, "learn_weights", events)
    got = ngram_lm.score_texts(docs, part, coded=coded).collect()
    model, table = kept["model"], [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 10, [*words(r.text), "\n"]) for r in docs.collect()]
    size = lambda n: math.ceil(math.log2(n + 1))

    def counts(folds):
        uni, pairs, context = collections.Counter(), collections.Counter(), collections.Counter()
        for _, f, ws in table:
            if f in folds:
                uni.update(ws)
                pairs.update(zip([None, *ws], ws))
                context.update([None, *ws[:-1]])
        return uni, pairs, context

    uni, pairs, context = counts(range(1, 9))
    want = collections.Counter()
    for (a, b), n in counts([9])[1].items():
        want[size(context[a]), round(pairs[a, b] / max(context[a], 1), 9), round(uni[b] / sum(uni.values()), 12)] += n
    have = collections.Counter()
    for e in kept["events"]:
        for b, f12, f1, n in zip(*(v.tolist() for v in e)):
            have[b, round(f12, 9), round(f1, 12)] += n
    assert have == want
    uni, pairs, context = counts(range(1, 10))
    total = sum(uni.values())
    want, have = collections.defaultdict(list), collections.defaultdict(list)
    for i, _, ws in table:
        score = 0.0
        for a, b in zip([None, *ws], ws):
            lam = model.weights[size(context[a])]
            score += math.log10(lam[0] * pairs[a, b] / max(context[a], 1) + lam[1] * uni[b] / total + lam[2] / (len(uni) + 1))
        want[i].append((len(ws), sum(uni[w] > 0 for w in ws), sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1))) for w in ws), score))
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert want.keys() == have.keys()
    for i in want:
        for a, b in zip(sorted(want[i]), sorted(have[i]), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


def test_lm_orders_and_places_match_plain_ones():
    rng = np.random.default_rng(6)
    near = np.array([2**63 + 5, 2**63 + 4, 2**63 + 5, 7, 2**64 - 1, 0, 7], dtype=np.uint64)  # differ in their last bits only
    wide = np.concatenate((near, rng.choice(rng.integers(0, 2**64, 400, dtype=np.uint64), 3_000)))
    for columns in ((wide,), (wide, wide[::-1], rng.integers(0, 9, len(wide)).astype(np.uint32)), (rng.integers(-4, 4, 500), rng.integers(0, 4, 500)), (wide.astype(np.uint32),), (wide[:0], wide[:0]), (wide[:1], wide[:1])):
        order, new = ngram_lm._groups(*columns)
        assert (order == np.lexsort(columns[::-1])).all()
        rows = list(zip(*(c[order].tolist() for c in columns)))
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]
    for hashes in (np.unique(wide), rng.permutation(np.unique(wide.astype(np.uint32))), np.arange(3_000, dtype=np.uint32), wide[:0], wide[:1]):
        asked = np.concatenate((hashes, hashes[:50] + hashes.dtype.type(1), rng.integers(0, 2**32, 200).astype(hashes.dtype)))
        where = {h: i for i, h in enumerate(hashes.tolist())}
        assert ngram_lm.Places(hashes).of(asked).tolist() == [where.get(h, -1) for h in asked.tolist()]


def test_lm_counts_pass_32_bits(spark):
    """Counts of a corpus are added up and carried as 64-bit numbers."""
    from loomwork.llm.words import deltas, planes

    end, many = int(ngram_lm.END), (1 << 33) + 5
    keys = np.array(sorted([7, end]), np.uint64)
    counts = np.array([3, many] if end > 7 else [many, 3], np.int64)
    packed = spark.createDataFrame([(0, bytearray(deltas(keys)), bytearray(planes(counts)), bytearray(planes(counts * 2)))], "bucket int, keys binary, estimate binary, held binary")
    final, estimate = ngram_lm._vocabulary(packed, 10)
    assert final.tokens == 3 * (many + 3) and estimate.tokens == many + 3 and many * 3 in final.counts.tolist() and many in estimate.counts.tolist()
    table = pa.table({"kind": pa.array([1], pa.int32()), "keys": [deltas(keys)], "docs": [planes(counts)], "counts": [planes(counts * 2)]})
    known = ngram_lm._known(table, 1)
    assert [x.tolist() for x in ngram_lm._looked_up(known, np.array([end, 9], np.uint64))] == [[many, 0], [2 * many, 0]]


def test_lm_weights_raise_the_likelihood_of_held_out_counts(spark):
    rng = np.random.default_rng(0)
    b, f12, f1, n = rng.integers(1, 4, 300).astype(np.uint8), rng.random(300) * (rng.random(300) < 0.5), rng.random(300) / 50, rng.integers(1, 9, 300)
    events = spark.createDataFrame([(0, bytearray(b.tobytes()), bytearray(f12.tobytes()), bytearray(f1.tobytes()), bytearray(n.astype(np.int64).tobytes()))], "kind int, b binary, f12 binary, f1 binary, n binary")
    value = lambda w: float((n * np.log(w[b, 0] * f12 + w[b, 1] * f1 + w[b, 2] / 100)).sum())
    seen = [value(ngram_lm.learn_weights(events, 100, rounds)) for rounds in (1, 3, 8)]
    assert seen[0] < seen[1] < seen[2] and np.allclose(ngram_lm.learn_weights(events, 100, 8).sum(axis=1), 1)


def test_op3_beats_the_base_on_unseen_texts(spark, sf_dir):
    got = [r for r in queries.op3_ngram_lm(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_raking_meets_its_targets():
    rng = np.random.default_rng(3)
    cells = [(f"s{i}", f"l{j}", f"t{k}") for i in range(4) for j in range(3) for k in range(2)]
    tokens = rng.integers(10, 1000, len(cells))
    targets = [{f"s{i}": 0.25 for i in range(4)}, {"l0": 0.5, "l1": 0.3, "l2": 0.2}, {"t0": 0.9, "t1": 0.1}]
    w = mixing.rake(cells, tokens, targets, 200, 1e-12)
    for d, target in enumerate(targets):
        for name, share in target.items():
            assert sum(x for c, x in zip(cells, w) if c[d] == name) == pytest.approx(share * tokens.sum(), rel=1e-6)
    p = mixing.calibrated(tokens, w / tokens, 0.4 * tokens.sum())
    assert (p * tokens).sum() == pytest.approx(0.4 * tokens.sum()) and p.max() <= 1
    assert (mixing.calibrated(tokens, w / tokens, 2.0 * tokens.sum()) == 1).all()


def test_mixing_odd_rows(spark):
    df = awkward(spark).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a"))
    dims = {"source": F.col("source")}
    got = mixing.mix(df, dims, 0.5).collect()
    assert len(got) == df.count() and {r.source for r in got} == {"a", mixing.MISSING}
    kept = mixing.mixed_rows(df, dims, 0.5)
    assert kept.columns == df.columns and sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in got if r.sampled)
    assert mixing.mix(df.where("false"), dims, 0.5).count() == 0
    clash = df.withColumns({"mix_0": F.lit("mine"), "MIX_prob": F.lit(7), "a.b": F.lit("dot")})
    kept = mixing.mixed_rows(clash, dims, 0.5)
    assert kept.columns == clash.columns and {(r.mix_0, r.MIX_prob, r["a.b"]) for r in kept.collect()} == {("mine", 7, "dot")}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    found = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(found.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[found.columns.index(c)] for c in cols)) for r in found.fetchall())


def test_op4_contract(spark, sf_dir):
    import hashlib

    from tests.llm.test_texts import padded

    for r in queries.op4_flac(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").limit(40).collect():
        want = padded(r.text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(r.text.encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))


def test_pipeline_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns and after.subtract(before).count() == 0
        if name == "near_copies":
            table = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in after.collect()} == set(brute(table, 5, 80, 100).values())
        if name == "language":
            assert after.count() == before.where("text rlike '[a-zA-Z]'").count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in before.collect())
    odd = awkward(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for table in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf_dir).count()


def test_settled_tables_are_removed_on_demand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert common.settled(spark.range(5)).count() == 5 and list(tmp_path.glob("settled-*/*"))
    common.forget_settled(spark)
    common.forget_settled(spark)  # nothing is left: no error
    assert not list(tmp_path.glob("settled-*"))
