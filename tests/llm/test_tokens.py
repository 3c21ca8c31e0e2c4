"""Token counts, alignment of tokenizers, and collocations."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from loomwork.llm import alignment, collocations, queries, token_counts
from tests.conftest import rows
from tests.llm.test_texts import awkward, documents, empty

A, B = public_tokenizers.path("byte_bpe_50k.json"), queries.model_path()


def lengths(path):
    """The library's own count of a text's tokens."""
    if path == B:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=B)
        return lambda text: len(model.encode(text or ""))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [A, B])
def test_counts_are_the_librarys_own(spark, sf_dir, path):
    texts = awkward(spark).select("doc_id", "text").union(documents(spark, sf_dir).select("doc_id", "text"))
    texts = texts.union(spark.createDataFrame([(-1, "x<|endoftext|>y <s>")], "doc_id long, text string"))
    count = lengths(path)
    want = sorted((repr(r.doc_id), len((r.text or "").encode()), count(r.text)) for r in texts.collect())
    got = token_counts.count_tokens(texts, path)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    cache = f"file://{tmp_path}/counts"
    held = lambda path=B: token_counts.cached_counts(spark, cache, token_counts.tokenizer_version(path))
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, ""), (5, "a▁b"), (6, "a b"), (6, "a b"), (None, "no id")], "doc_id long, text string")
    got = token_counts.count_tokens(first, B, cache)
    assert not any(r.cached for r in got.collect()) and got.count() == 8
    assert held().count() == 4  # equal contents, and those the model reads alike, are counted once
    more = first.union(spark.createDataFrame([(9, "new text")], "doc_id long, text string"))
    again = {(r.doc_id, r.cached) for r in token_counts.count_tokens(more, B, cache).collect()}
    assert again == {(1, True), (2, True), (3, True), (4, True), (5, True), (6, True), (None, True), (9, False)}
    assert held().count() == 5
    # another tokenizer finds nothing of the first one's, nor does a changed file of the same one
    assert not any(r.cached for r in token_counts.count_tokens(first, A, cache).collect())
    assert held(A).count() == 5 and held().count() == 5
    (tmp_path / "changed.model").write_bytes(open(B, "rb").read() + b"\0")
    assert token_counts.tokenizer_version(str(tmp_path / "changed.model")) != token_counts.tokenizer_version(B)
    # what two runs have appended side by side counts once
    held().write.mode("append").parquet(f"{cache}/{token_counts.tokenizer_version(B)}/batch-twice")
    assert rows(token_counts.count_tokens(more, B, cache).select("doc_id", "n_tokens")) == rows(token_counts.count_tokens(more, B).select("doc_id", "n_tokens"))


def test_a_wrong_count_in_the_cache_is_what_comes_back(spark, tmp_path):
    """So the counts of hits are taken from the cache and not made again."""
    cache, version = f"file://{tmp_path}/counts", token_counts.tokenizer_version(B)
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    token_counts.count_tokens(one, B, cache)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"y").digest()), 77)], token_counts.COUNTS).write.parquet(f"{cache}/{version}/batch-odd")
    two = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(two, B, cache).collect()} == {1: lengths(B)("x"), 2: 77}


def test_long_texts_are_counted_in_parts():
    text = "word  two\n three ▁four " * 300 + "x" * 900 + " end "
    assert len(list(token_counts.parts(text, 100))) > 20
    counter, count = token_counts.Counter(B), lengths(B)
    assert sum(counter([p for p in token_counts.parts(text, 100)])) == count(text)


def test_op11_contract(spark, sf_dir):
    got = queries.op11_token_counts(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    count = lengths(B)
    assert rows(got) == sorted((r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 4096) for r in documents(spark, sf_dir).collect())


def plainly_aligned(text):
    """(n_a, n_b), groups as text and linked pairs, by walking both lists of tokens."""
    v = alignment.vocabularies(A, B)
    if not text:
        return (0, 0), "", []
    whole = (" " + text).encode()
    a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
    if b"".join(v.a_bytes[i] for i in a) != whole or b"".join(v.b_bytes[i] for i in b) != whole:
        return (0, 0), "", []
    ends_a, ends_b = np.cumsum(v.a_size[a]).tolist(), np.cumsum(v.b_size[b]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    text_of = lambda ids: ",".join(map(str, ids))
    return (len(a), len(b)), ";".join(f"{text_of(x)}|{text_of(y)}" for x, y in groups), [(x[-1], y[-1]) for x, y in groups]


@pytest.mark.parametrize("size", [500_000, 50])
def test_alignment_of_random_texts(size):
    rng, v = random.Random(3), alignment.vocabularies(A, B)
    assert v.independent
    letters = [*"ab'stréß漢🙂12,.!-_<>|", *" " * 6, "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　", "\x00", "<|endoftext|>", "<s>", "<0x41>", "  ", "\n\n", " \n", "don't", "​", "́"]
    texts = ["".join(rng.choice(letters + ["▁"] * (k % 5 == 0)) for _ in range(rng.randint(0, 40))) for k in range(4000)]
    aligner = alignment.Aligner(A, B, size)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        numbers, groups, links = aligner.align(part)
        for text, n, g, ls in zip(part, numbers.tolist(), groups, np.split(links, np.cumsum(numbers[:, 2]))):
            want = plainly_aligned(text)
            assert ((n[0], n[1]), g, [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in v.pairs[ls]]) == want, text


def test_pointers_reach_the_last_token_of_each_group():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = int(rng.integers(1, 400))
        a, b = (np.append(np.flatnonzero(rng.random(size - 1) < rng.choice([0.02, 0.4, 0.9])) + 1, size) for _ in range(2))
        both = np.intersect1d(a, b)
        last = alignment.last_of_groups(a, b)
        ends = np.concatenate((a, b))
        assert (ends[last] == both[np.searchsorted(both, ends)]).all() and (last >= len(a)).all()


def test_op12_counts_links_of_all_documents(spark, sf_dir):
    got = queries.op12_alignment(spark, sf_dir)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    plain = {r.doc_id: plainly_aligned(r.text) for r in documents(spark, sf_dir).collect()}
    counts = Counter(link for _, _, links in plain.values() for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for r in got.collect():
        (a, b), groups, links = plain[r.doc_id]
        sums = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert tuple(r)[1:] == (a, b, len(links), len(links), *sums, digest)
    assert got.count() == len(plain)


def test_alignment_of_odd_rows(spark):
    aligned = alignment.settled_digests(alignment.align_texts(awkward(spark), A, B))
    got = alignment.with_link_counts(aligned, A, B).collect()
    want = sorted((repr(r.doc_id), *plainly_aligned(r.text)[0]) for r in awkward(spark).collect())
    assert sorted((repr(r.doc_id), r.n_a, r.n_b) for r in got) == want
    nothing = alignment.settled_digests(alignment.align_texts(empty(spark), A, B))
    assert alignment.with_link_counts(nothing, A, B).count() == 0


def plainly_mined(table, least, top, longest=4):
    import re

    counts, totals = Counter(), Counter()
    for lang, text in table:
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for (lang, *words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        holders = [f for (other, *longer), f in counts.items() if other == lang and len(longer) > len(words) and f >= least and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if any(100 * f >= 80 * a for f in holders):
            continue
        cuts = [(2_000_000 * a // (counts[lang, *words[:j]] + counts[lang, *words[j:]]), j) for j in range(1, len(words))]
        score, j = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, *words[:j]], counts[lang, *words[j:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for lang, *rest in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], *rest))
    return ranked


@pytest.mark.parametrize("block,bucket", [(16 << 20, 2_000_000), (200, 3)])
def test_collocations_match_a_plain_count(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    rng = random.Random(8)
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0c", " - "]
    texts = [(rng.choice(["x", "y", None, "und"]), "".join(rng.choice(["A", "b", "c", "Éa", "c\x00d", " ", "b"]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    texts += [("x", None), ("x", ""), ("x", "p q r s " * 9), ("z", "solo"), ("y", "l" * 5000 + " m"), *[("w", "in the end of it")] * 7]
    df = spark.createDataFrame([(lang, t, 1, "c") for lang, t in texts], "lang string, text string, n long, phrase string")
    for least, top in ((5, 2000), (7, 3)):
        got = collocations.collocations(df, least=least, top=top)
        assert sorted(tuple(r) for r in got.collect()) == sorted(plainly_mined(texts, least, top))
    assert collocations.collocations(df.where("false")).count() == 0
    assert collocations.collocations(df, least=10**6).count() == 0


def test_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    """A writer that first looks after 100 rows would hold as many blocks, of megabytes each, at once."""
    import pyarrow.parquet as pq

    from loomwork.llm import common

    monkeypatch.setattr(collocations, "BLOCK", 100_000)
    monkeypatch.setattr(common, "ROW_GROUP", 1 << 20, raising=False)
    rng = random.Random(5)
    texts = [("x", " ".join(f"w{rng.randrange(10**6)}" for _ in range(13_000))) for _ in range(60)]
    df = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    blocks = collocations.word_blocks(df, "lang", "text")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert blocks.count() >= 50 and sum(groups) > 8 << 20 and max(groups) < 3 << 20
    assert spark.conf.get(name) == before
