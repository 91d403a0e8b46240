"""Each operator against a plain version on small documents, and on odd rows."""

import hashlib
import math
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import SCHEMA, documents, fold, odd_rows, synthetic, with_clashes, words
from tests.oracle import same
from tidemark.llm import fingerprint, jaccard_join, language_id, lm_score, mixing, quality_model, quality_rules, queries, sentencepiece_bpe, token_count, url_filter
from tidemark.llm.session import settle

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="ab theinг▁ \n\t'1", max_size=80), max_size=20)


def keyed(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    settle(spark)
    return documents(spark).cache()


@pytest.fixture(scope="module")
def made(spark):
    settle(spark)
    return documents(spark, synthetic(300)).cache()


RUNS = {
    "op1": lambda s, d: fingerprint.edited_pairs(d),
    "op1_plain": lambda s, d: fingerprint.fingerprints(d),
    "op2": lambda s, d: mixing.mix(d.select("doc_id", "lang", "source", mixing.token_weight(F.col("text")).alias("n_tokens")), ["source", "lang"]),
    "op3": lambda s, d: quality_rules.judge(d, [F.col("doc_id")]),
    "op4": lambda s, d: lm_score.score(d, *lm_score.train(d, F.crc32(F.col("doc_id").cast("string")) % 5 != 1), [F.col("doc_id")]),
    "op5": lambda s, d: quality_model.score(d, quality_model.fit(d, s.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1)], "doc_id bigint, quality int"), F.lit(True)), [F.col("doc_id")]),
    "op6": lambda s, d: sentencepiece_bpe.encode_decode(d, MODEL),
    "op8": lambda s, d: jaccard_join.join(d),
    "op9": lambda s, d: language_id.identify(d, F.lit(True), [F.col("doc_id")]),
    "op10": lambda s, d: token_count.count_tokens(d, VOCAB),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_empty_tables_and_clashing_columns(spark, odd, name):
    plain = RUNS[name](spark, odd).collect()
    assert len(plain) == len(odd_rows())
    assert sorted(map(str, RUNS[name](spark, with_clashes(odd)).collect())) == sorted(map(str, plain))
    assert RUNS[name](spark, documents(spark, [])).count() == 0
    same_text = [r for r in plain if r["doc_id"] == 4]
    assert len(same_text) == 3 and (name == "op1" or len({str(r) for r in same_text}) == 1)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


# 1


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likeness(spark, made):
    got, rows = keyed(fingerprint.edited_pairs(made)), sorted(made.collect(), key=lambda r: -r.doc_id)
    errors = []
    for i, r in enumerate(rows):
        t, n = r.text, rows[(i + 1) % len(rows)].text
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [g.near_edited - jaccard(shingle_set(t, 5), shingle_set(edited, 5)), g.near_next - jaccard(shingle_set(t, 5), shingle_set(n, 5))]
    assert sum(map(abs, errors)) / len(errors) < 0.06
    prints = keyed(fingerprint.fingerprints(made))
    assert all(prints[k].fingerprint == got[k].fingerprint for k in got)


def test_fingerprints_merge_and_contain():
    h = lambda t: fingerprint.hashes_of(t)
    data = [" ".join(f"a{i}" for i in range(4000)), " ".join(f"a{i}" for i in range(400))]
    prints = []
    for t in data:
        import numpy as np

        raw = np.frombuffer(t.encode(), np.uint8)
        prints.append(fingerprint.text_of(*fingerprint.sketch(raw, np.array([0, len(raw)])))[0])
    assert fingerprint.containment(h(prints[1]), h(prints[0])) > 0.9 > 0.2 > fingerprint.containment(h(prints[0]), h(prints[1]))
    assert set(h(fingerprint.merge(*prints))) >= {x for x in h(prints[0]) if x < fingerprint.FRACTION * 2**48}


# 2


def test_margins_are_met_and_draws_follow_probabilities(spark):
    rows = [(i, f"s{(i % 10 > 6) + (i % 10 > 8)}", ["en", "fr"][i % 4 == 0], 5 + i % 7) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_tokens bigint")
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"en": 0.4, "fr": 0.6}}
    out = mixing.mix(docs, ["source", "lang"], targets=targets, rounds=12).toPandas()
    share = out.n_tokens * out.weight
    for dim, by in targets.items():
        got = share.groupby(out[dim]).sum() / share.sum()
        assert all(abs(got[v] - s) < 1e-3 for v, s in by.items())
    assert out.probability.max() == pytest.approx(1.0) and 0.9 < out.selected.sum() / out.probability.sum() < 1.1


def test_topics_are_common_words_of_few_documents(spark):
    texts = ["all red red blue"] * 2 + ["all blue"] * 2 + ["all"] * 36 + [None]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    assert mixing.topic_words(docs) == ["blue", "red"]
    got = {r.doc_id: (r.topic, r.n_tokens) for r in mixing.with_topics(docs, [F.col("doc_id")]).collect()}
    assert (got[0], got[2], got[39], got[40]) == (("red", 4), ("blue", 2), ("other", 1), ("other", 0))
    drawn = mixing.drawn(with_clashes(documents(spark)))
    assert drawn.columns == with_clashes(documents(spark)).columns and mixing.drawn(documents(spark, [])).count() == 0


# 3


def repeats(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, spots = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            spots |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots)


def swapped(n, other=False):
    """The n-th word of a sequence whose words a polynomial modulo 2**64 does not tell from their mirror images."""
    return "".join("ab"[(bin(i).count("1") + other) % 2] for i in range(n))


def test_words_with_one_polynomial_are_told_apart(spark):
    import numpy as np
    import sentencepiece

    from tidemark.llm.textvec import hashes
    from tidemark.llm.textvec import words as cut

    texts = [f"{swapped(n, other)} one two three" for n in (64, 1024, 2048) for other in (False, True)]
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    assert len(set(hashes(cut(raw, np.array([0, len(raw)]))).tolist())) == 9
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, counts = sentencepiece_bpe.Pieces(MODEL).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]
    docs = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    assert all(r.component_id == r.doc_id for r in jaccard_join.join(docs, k=4, percent=85).collect())


def test_encoding_looks_behind_an_equal_hash(monkeypatch):
    import numpy as np
    import sentencepiece

    monkeypatch.setattr(sentencepiece_bpe, "hashes", lambda w: np.zeros(len(w.at), np.uint64))
    texts = ["the cat and the dog", "a cat", "", "the end"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, counts = sentencepiece_bpe.Pieces(MODEL).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]


def test_repeats_are_exact_behind_an_equal_hash(spark, odd, monkeypatch):
    monkeypatch.setattr(quality_rules, "WINDOW_HASH", lambda *h: F.pmod(h[0], F.lit(3)))
    for r in quality_rules.judge(odd.where("octet_length(text) < 5000").dropDuplicates(["doc_id"]), [F.col("doc_id"), F.col("text")]).collect():
        assert r.n_repeat_words == repeats(r.text)[4]


def test_counts_of_rules(spark, odd):
    for r in quality_rules.judge(odd.dropDuplicates(["doc_id"]), [F.col("doc_id"), F.col("text")]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == repeats(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_rules_drop_outliers_of_a_group_only(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "s", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(f"w{i}y{j}***" for j in range(80)), "en", "s", 0) for i in range(5)]
    kept = {r.doc_id for r in quality_rules.judge(documents(spark, rows), [F.col("doc_id")]).where("kept").collect()}
    assert kept == set(range(200))
    assert {r.doc_id for r in quality_rules.passing(documents(spark, rows)).collect()} == kept


# 4


def test_base_score_counts_and_gain(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    counts = Counter(t for i, x in zip(docs.doc_id, docs.text) if fold(i, 5) != 1 for t in [*words(x), None])
    n, v = sum(counts.values()), len(counts)
    got = keyed(queries.op4_lm_score(spark, sf))
    for i, x in zip(docs.doc_id, docs.text):
        t, r = [*words(x), None], got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, fold(i, 5) == 1)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_that_of_plain_probabilities(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    tokens = {i: [*words(x), None] for i, x in zip(docs.doc_id, docs.text)}
    train = [t for i, t in tokens.items() if fold(i, 5) != 1]
    single, pair = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([0, *t], t))
    n, v = sum(single.values()), len(single)
    of = lambda c: lm_score.COUNT_OF[int(lm_score.level(c))]
    got = keyed(queries.op4_lm_score(spark, sf))
    wrong = 0
    for i, t in tokens.items():
        total = 0.0
        for a, b in zip([0, *t], t):
            c, before = of(single[b]), of(single[None]) if a == 0 else of(single[a])
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            seen = min(of(pair[a, b]), c, before)
            total += math.log10(min((seen + lm_score.PRIOR * p) / (before + lm_score.PRIOR), 1.0))
        assert got[i].score == pytest.approx(total, rel=0.02)
        wrong += abs(got[i].score - total) > 1e-6 * abs(total)
    assert wrong <= 0.5 * len(tokens)  # the filter takes some n-grams that it does not hold for rare ones


def test_filter_reads_counts_back(spark):
    import numpy as np

    keys = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 3001) ** 2
    table = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys.view(np.int64), counts)], "h bigint, c bigint")
    read = lm_score.Filter(lm_score.build(table)).read(keys)
    assert np.mean(np.abs(np.log(read / counts)) < np.log(lm_score.STEP)) > 0.95
    absent = lm_score.Filter(lm_score.build(table)).read(keys + np.uint64(7))
    assert np.mean(absent == 0) > 0.95


def test_filter_keeps_single_counts_at_any_size(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm_score, "MAX_BYTES", 1 << 10, raising=False)
    keys = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    table = spark.createDataFrame([(int(k), 1) for k in keys.view(np.int64)], "h bigint, c bigint")
    assert (lm_score.Filter(lm_score.build(table)).read(keys) >= 1).all()


def test_pairs_of_rare_words_count(spark):
    filler = " ".join(f"w{i}" for i in range(2500))
    rows = [(i, filler, "en", "s", 0) for i in range(3)] + [(5, "alpha beta", "en", "s", 0), (6, "alpha beta", "en", "s", 0), (7, "beta alpha", "en", "s", 0)]
    docs = documents(spark, rows)
    got = keyed(lm_score.score(docs, *lm_score.train(docs, F.col("doc_id") < 7), [F.col("doc_id")]))
    assert got[5].base_score == pytest.approx(got[7].base_score)
    assert got[5].score > got[7].score + 1


# 5


def test_held_out_quality(spark, sf):
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    got = queries.op5_quality_model(spark, sf).toPandas().set_index("doc_id")
    assert all(got.held_out[i] == (fold(i, 3) == 1) for i in got.index)
    held = got[got.held_out].join(labels, how="inner")
    assert (held.predicted == held.quality).mean() >= 0.9 and got.score.between(0, 1).all()


def test_word_vectors_are_sums_of_neighbours(spark):
    import numpy as np

    texts = ["red fox runs far", "red fox sleeps", "blue whale", "one"]
    sketch = quality_model.word_vectors(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    of = lambda t: quality_model.hashes(quality_model.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))

    def dense(word):
        place, sign = quality_model.index(of(word), quality_model.CONTEXT)
        return np.bincount(place[0], sign[0], minlength=quality_model.CONTEXT)

    want = {"fox": [dense("red"), dense("runs"), dense("red"), dense("sleeps")], "whale": [dense("blue")], "one": []}
    for word, parts in want.items():
        total = 2 * sum(parts, np.zeros(quality_model.CONTEXT))  # both tables hold it
        assert np.allclose(quality_model.vectors_of(of(word), sketch)[0], total / max(np.linalg.norm(total), 1), atol=1e-5)


def test_equal_texts_pool_alike_wherever_they_stand():
    import numpy as np

    r = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in r.integers(0, 1 << 30, 999))
    data = np.frombuffer(" ".join([text] * 150).encode(), np.uint8)  # more words than were ever pooled at once
    off = np.append(np.arange(150) * (len(text) + 1), len(data))
    vectors = r.normal(size=(quality_model.TABLES * quality_model.BUCKETS, quality_model.CONTEXT)).astype(np.float32)
    got = quality_model.pool(data, off, vectors)
    assert (got == got[0]).all()
    p = quality_model.PART
    cuts = [(s.start, s.stop) for s in quality_model._cuts(np.array([0, p, 5, 0, 2 * p + 7, 3]))]
    assert cuts == [(0, p), (p, p + 5), (p + 5, 2 * p + 5), (2 * p + 5, 3 * p + 5), (3 * p + 5, 3 * p + 15)]


def test_a_task_gathers_a_large_batch_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([" ".join(f"w{i * j % 9973}" for j in range(400)) for i in range(1, 3500)])
    assert texts.nbytes > 6e6
    tracemalloc.start()
    blocks = list(quality_model.gather(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert blocks and most < 110e6


# 6


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_pieces_equal_the_library(texts):
    import numpy as np
    import sentencepiece

    ours, library = test_pieces_equal_the_library.ours, test_pieces_equal_the_library.library
    if ours is None:
        ours = test_pieces_equal_the_library.ours = sentencepiece_bpe.Pieces(MODEL)
        library = test_pieces_equal_the_library.library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, counts = ours.encode(texts)
    ends = np.cumsum(counts)
    decoded = ours.decode(ids, counts)
    for t, a, b, d in zip(texts, ends - counts, ends, decoded):
        want = library.encode(t)
        assert ids[a:b].tolist() == want and d.decode() == library.decode(want)


test_pieces_equal_the_library.ours = test_pieces_equal_the_library.library = None


def test_digests_and_full_output(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    full = sentencepiece_bpe.encode_decode(odd, MODEL, output="full").collect()
    for r, d, row in zip(full, sentencepiece_bpe.encode_decode(odd, MODEL).collect(), odd.collect()):
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        assert (list(r.ids), r.decoded) == (ids, library.decode(ids))
        assert d.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest() and d.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# 7


def test_urls(spark):
    urls = ["https://A.Example.com/en/7?x", "http://x.com/en/", "http://x.com/fr/", None, "no scheme", "http://q.example.net/de/81", "ftp://spam.test/a/b#c", "http://notcom/en/", "http://com/en/x", "http://host", "http://host?x=/en/", "http://a.b.spam.test/a"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    listed = url_filter.listing(spark, queries.URL_RULES, [("block", "spam.test/a")])
    got = keyed(url_filter.judge(pages, listed), "page_id")
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), (None, "block"), (None, "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), (None, "block"),
    ]
    assert (got[0].host, got[0].path, got[10].host, got[10].path) == ("a.example.com", "/en/7", "host", "")
    none = spark.createDataFrame([], url_filter.LIST_SCHEMA)
    assert {r.verdict for r in url_filter.judge(with_clashes(pages), none).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark):
    urls = ["http://a.net/de/1", "http://example.net/de/7", "http://example.net/de/8", "http://x.com/en/1", "http://example.com/en/7", "http://x.org/es/1"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = keyed(url_filter.judge(pages, url_filter.listing(spark, queries.URL_RULES, [])), "page_id")
    assert [(got[i].verdict, got[i].rule) for i in range(len(urls))] == [
        ("allow", "net/de/"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "org/es/"),
    ]


def test_listed_urls_are_canonical(spark):
    urls = ["http://A.test:80/x%7Ey//z", "https://a.test./x~y/z/more", "http://b.a.test/x~y/zz", "http://a.test/%zz", "http://a.test/" + "d/" * 3000, None]
    pages = spark.createDataFrame([(i % 5, u, "") for i, u in enumerate([*urls, urls[0], urls[0]])], "page_id bigint, url string, html string")
    listed = url_filter.listing(spark, [], [("block", "a.test:443/x~y/z")])
    got = [(r.host, r.verdict) for r in url_filter.judge(with_clashes(pages), listed).collect()]
    assert sorted(got) == sorted([("a.test:80", "block")] * 3 + [("a.test.", "block"), ("b.a.test", "allow"), ("a.test", "allow"), ("a.test", "allow"), ("", "allow")])
    assert url_filter.judge(pages.limit(0), listed).count() == 0


# 8


def brute_groups(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t, *_ in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60), (1, 90)])
def test_groups_equal_all_pairs(spark, made, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(made, k=k, percent=percent).collect()}
    assert got == brute_groups([tuple(r) for r in made.collect()], k, percent)


def test_groups_with_small_blocks(spark, made, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "SUBGROUP", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(made, k=2, percent=60).collect()}
    assert got == brute_groups([tuple(r) for r in made.collect()], 2, 60)


def test_join_bounds_its_batches_and_leaves_the_session_as_it_was(spark, made, monkeypatch):
    key, seen, save = "spark.sql.execution.arrow.maxBytesPerBatch", set(), jaccard_join.save
    monkeypatch.setattr(jaccard_join, "save", lambda df, *a: (seen.add(int(spark.conf.get(key))), save(df, *a))[1])
    before = spark.conf.get(key)
    got = jaccard_join.join(made)
    assert seen == {jaccard_join.BATCH} and jaccard_join.BATCH < int(before) and spark.conf.get(key) == before
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_document_of_each_group_stays(spark, odd, made):
    left = jaccard_join.one_of_each(made, k=4, percent=85)
    want = {i for i, (_, c) in brute_groups([tuple(r) for r in made.collect()], 4, 85).items() if i == c}
    assert {r.doc_id for r in left.collect()} == want and left.columns == made.columns
    kept = [r.doc_id for r in jaccard_join.one_of_each(odd).collect()]
    assert sorted(kept, key=str) == sorted([0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, None], key=str)


# 9


def test_held_out_languages(spark, sf):
    langs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").lang
    got = queries.op9_language(spark, sf).toPandas().set_index("doc_id")
    assert all(got.held_out[i] == (fold(i, 5) == 0) for i in got.index)
    held = got[got.held_out].join(langs)
    assert (held.lang_pred == held.lang).mean() >= 0.95 and got.score.between(0, 1).all()


def test_languages_by_plain_products(spark):
    import numpy as np

    texts = [(0, "The cat, the hat", "en"), (1, "der Hut und die Katze", "de"), (2, "Ünder das hat", "de"), (3, "日本 𝔘", "xx")]
    docs = documents(spark, [(i, t, lang, "s", 0) for i, t, lang in texts])
    letters = lambda c: language_id.letter_vectors(np.array([ord(c) if c else 0]))[0].astype(float)

    def vector(text):
        total = np.zeros(language_id.DIM)
        for word in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split():
            padded = ["", *word, ""]
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                total += np.roll(letters(a), 2) * np.roll(letters(b), 1) * letters(c)
        return total

    langs, protos = language_id.prototypes(language_id.learn(docs))
    for lang, got in zip(langs, protos):
        want = sum(vector(t) for _, t, other in texts if other == lang)
        assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)
    for r in language_id.identify(docs, F.lit(True), [F.col("doc_id"), F.col("text")]).collect():
        v = vector(r.text)
        cosines = protos @ v / np.linalg.norm(v)
        assert r.lang_pred == langs[int(cosines.argmax())] and r.score == pytest.approx(cosines.max(), abs=1e-5)


def test_texts_without_letters_are_undetermined(spark, odd):
    got = keyed(language_id.identify(odd, F.lit(True), [F.col("doc_id")]))
    assert {got[i].lang_pred for i in (0, 1, 2, 12)} == {"und"} and got[3].lang_pred in ("en", "fr")


# 10


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(texts):
    from tokenizers import Tokenizer

    texts = [*texts, "a<|endoftext|>b <|endoftext|>", "\x1c \x85　x"]
    special, places, counts, asked = token_count.frequencies(token_count.pre_tokens(VOCAB), texts, 4)
    pieces = token_count.pre_tokens(VOCAB).pieces([p for _, part in asked for p in part])
    got = [n + int((pieces[k] * c).sum()) for n, k, c in zip(special, places, counts)]
    assert got == [len(e) for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False)]


def test_counts_of_the_query_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = [len(e) for e in Tokenizer.from_file(VOCAB).encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False)]
    got = keyed(queries.op10_token_counts(spark, sf))
    assert [(got[i].n_bytes, got[i].n_tokens, got[i].over_limit) for i in docs.doc_id] == [(len((t or "").encode()), n, n > 1024) for t, n in zip(docs.text, want)]


# Pipeline


def test_pipeline_stages_keep_their_promises(spark, sf):
    settle(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.save(stage(spark, before, sf), name.replace(" ", "-"))
        assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0 and 0 < docs.count() <= before.count()
        if name == "quality rules":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in quality_rules.judge(before, [F.col("doc_id")]).where("kept").collect())
        if name == "n-gram Jaccard join":
            want = {i for i, (_, c) in brute_groups([tuple(r) for r in before.select("doc_id", "text").collect()], 5, 80).items() if i == c}
            assert {r.doc_id for r in docs.collect()} == want
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert [r.doc_id for r in corpus_pipeline.run(spark, sf).orderBy("doc_id").collect()] == sorted(r.doc_id for r in docs.collect())


def test_stages_keep_columns_of_any_name(spark, odd, tmp_path):
    spark.createDataFrame([(4, 1), (9, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    wide = corpus_pipeline.save(with_clashes(odd), "wide")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns if name != "SentencePiece" else out.count() == wide.count()
        if name != "SentencePiece":
            kept = [str(r) for r in out.collect()]
            assert set(kept) <= {str(r) for r in wide.collect()} and (name != "n-gram Jaccard join" or len(kept) == len(set(kept)))


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    settle(spark)
    odd.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).count()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
