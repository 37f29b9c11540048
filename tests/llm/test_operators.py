"""The operators for training data against brute force, on small and odd inputs."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tabflow.llm import (
    adaptive_rules, bpe, embedding_dedup, langid, lm, packing, quality_gam, simhash_dedup,
    suffix_dedup, warc,
)

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COPY = "the same passage of more than two hundred bytes " * 6


def long_text(seed, words=300):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a long text, and extra columns with clashing names."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "A b!", "en", None),
        (4, "A b!", "en", None), (None, COPY + "x", "de", "b"), (None, COPY + "y", "de", "b"),
        (7, COPY + long_text(1, 20000), "en", "b"), (8, long_text(2), "fr", "c"), (9, long_text(2), "fr", "c"),
        (10, long_text(2) + " end", None, "c"), (11, "123 456 !?", "en", "a"), (12, "ünï çode ß 中文", "de", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", "1 AS id", "2 AS fp", "'x' AS score", "3 AS th", "4 AS kept", "5 AS n_tokens")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def tally(rows):
    return collections.Counter(map(tuple, rows))


def test_bpe_is_exact(spark, odd, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.bpe_decode(bpe.bpe_encode(odd, PATH, PATTERN), PATH)
    want = [(i, bytes(np.array(own.encode_ordinary(t), "<u4")), t.encode()) for i, t in texts_of(odd)]
    assert tally((r.id, bytes(r.ids), bytes(r.decoded)) for r in coded.collect()) == tally(want)
    assert bpe.bpe_encode(empty, PATH, PATTERN).count() == 0
    coder, r = bpe.Codec(PATH, PATTERN), random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice("aeth sn\n\t 019éü中😀'\x1c\x85") for _ in range(r.randint(0, 40)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == own.encode_ordinary(text)


def test_language_id(spark, odd, empty):
    rows = [(i, t * 3, k) for i, (t, k) in enumerate([("wie geht es dir heute ", "de"), ("how are you today ", "en")] * 4)]
    learned = langid.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    asked = spark.createDataFrame([(0, "geht heute"), (1, "you are"), (2, None), (3, "12 !")], "doc_id int, text string")
    found = {r.id: (r.lang_pred, r.score) for r in langid.predict(asked, learned).collect()}
    assert [found[i][0] for i in range(4)] == ["de", "en", "und", "und"]
    assert all(0 <= s <= 1 for _, s in found.values())
    assert langid.predict(odd, learned).count() == odd.count()
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(asked, nothing).collect()} == {"und"}


def test_repeats_by_brute_force(spark, odd, empty, monkeypatch):
    def check(df, length):
        docs = [(i, t.encode()) for i, t in texts_of(df)]
        seen = collections.Counter(b[k : k + length] for _, b in docs for k in range(len(b) - length + 1))
        want = []
        for i, b in docs:
            gone = set()
            for k in range(len(b) - length + 1):
                if seen[b[k : k + length]] > 1:
                    gone |= set(range(k, k + length))
            want.append((i, len(b), len(gone), bytes(x for k, x in enumerate(b) if k not in gone)))
        out = suffix_dedup.remove_repeats(df, length=length).collect()
        assert tally((r.id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out) == tally(want)
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in out)

    check(odd, 200)
    r = random.Random(3)
    passages = [long_text(k, 60) for k in range(4)]
    rows = [(k, long_text(100 + k, r.randint(1, 60)) + r.choice(passages)[r.randint(0, 50) :] + "a" * r.randint(0, 300)) for k in range(40)]
    mixed = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(mixed, 200)
    # One passage among many surroundings, near and far: a hot anchor, hot cores, hot strings.
    around = [(k, f"{long_text(k, 3)[: r.choice([0, 5, 20])]}{COPY[:230]}{r.choice('abc')}{long_text(900 + k, 4)[: r.choice([0, 3, 30])]}") for k in range(80)]
    hot = spark.createDataFrame(around, "doc_id bigint, text string")
    for size, run in ((3, 16), (8, 4), (30, 16)):
        monkeypatch.setattr(suffix_dedup, "HOT", size)
        monkeypatch.setattr(suffix_dedup, "RUN", run)
        check(mixed, 200)
        check(hot, 200)
        check(hot, 40)
    monkeypatch.setattr(suffix_dedup, "HOT", 4096)
    # Very many equal rows, of null ids too, whose spans are the same.
    equal = spark.createDataFrame([(None, COPY * 3 + "x")] * 300 + [(1, COPY * 3 + "x"), (2, "y" + COPY)], "doc_id bigint, text string")
    check(equal, 200)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_sort():
    r = random.Random(2)
    for _ in range(60):
        length, letters = r.choice([24, 33, 64]), r.choice(["ab", "abcdefgh", "a"])
        text = "".join(r.choice(letters) for _ in range(300)).encode() * r.choice([1, 2])
        starts = np.array([k for k in range(len(text) - length + 1) if r.random() < 0.8])
        order, same = suffix_dedup.deep_shallow(text, starts, np.zeros(len(starts), int), length)
        found = [text[starts[k] : starts[k] + length] for k in order]
        assert found == sorted(found)
        assert same.tolist() == [k > 0 and found[k] == found[k - 1] for k in range(len(found))]


def test_warc_round_trip(spark, tmp_path):
    html = "<p>" + "x" * 2000
    rows = [(1, "u", html), (2, "v\r\n", html), (3, None, html), (3, None, html), (None, "w", html), (4, "s", "tiny"), (5, "t", "tiny"), (6, "n", None), (7, "e", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest")
    out = warc.archive_pages(pages).collect()
    want = [
        (str(i) if i is not None else None, "revisit" if t == html and i != 3 else "response", "3" if t == html and i != 3 else None, len(t or ""), hashlib.sha1((t or "").encode()).hexdigest())
        for i, _, t in rows
    ]
    assert tally(r[:5] for r in out) == tally(want)
    assert {bytes(r.payload) for r in out if r.payload is not None} == {html.encode(), b"tiny", b"", b"\r\n\r\n"}
    assert warc.archive_pages(pages.limit(0)).count() == 0
    assert warc.learn_dictionary([b"abc" * 500 + bytes([k]) * 40 for k in range(60)]) is not None


def test_embedding_links_by_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 20))
    near = base[:25] + r.normal(size=(25, 20)) * 0.15
    vectors = [v.tolist() for v in [*base, *near, *near[:5], *(base[:3] * 2)]]
    odd = [None, [], [0.0] * 20, [float("nan")] * 20, [None] * 20, [1.0, 2.0], [float("inf")] + [1.0] * 19]
    rows = [(k, v) for k, v in enumerate(vectors + odd)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS node", "2 AS n")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    root = list(range(len(vectors)))
    for _ in root:
        root = [min([root[k], *(root[j] for j in np.flatnonzero(linked[k]))]) for k in range(len(root))]
    want = [(k, int(linked[k].sum()), root[k], root[k] == k) for k in range(len(vectors))]
    want += [(len(vectors) + k, 0, len(vectors) + k, True) for k in range(len(odd))]
    assert tally(embedding_dedup.embedding_components(df).collect()) == tally(want)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_quality_model(spark, odd, empty):
    rows = [(k, long_text(k, 60) if k % 3 else "SPAM!! ### " * 30) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality_gam.train(docs, labels)
    assert all(r.predicted == int(r.id % 3 > 0) for r in quality_gam.quality_scores(docs, model).collect())
    assert quality_gam.quality_scores(odd, model, keep=("source",)).count() == odd.count()
    blank = quality_gam.train(empty, labels)
    assert {r.score for r in quality_gam.quality_scores(odd, blank).collect()} == {0.5}


def test_simhash_by_brute_force(spark, odd, empty):
    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        grams = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    found = simhash_dedup.simhash_components(odd).collect()
    assert tally((r.id, r.fp % 2**64) for r in found) == tally((i, fingerprint(t)) for i, t in texts_of(odd))
    assert {r.component_id for r in found if r.id in (8, 9)} == {8}
    assert simhash_dedup.simhash_components(empty).count() == 0
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(30)]
    for _ in range(900):
        fps.append(r.choice(fps) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    fps = np.unique(np.array(fps, np.uint64))
    signed = [(int(x),) for x in fps.view(np.int64)]
    links = simhash_dedup.links(spark.createDataFrame(signed, "fp bigint")).collect()
    for a, b in links:
        assert bin((a ^ b) % 2**64).count("1") <= 2

    def groups(pairs):
        root = {x: x for (x,) in signed}
        def up(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[up(a)] = up(b)
        return {frozenset(y for (y,) in signed if up(y) == up(x)) for (x,) in signed}

    near = [(int(a), int(b)) for a in fps for b in fps[np.bitwise_count(fps ^ a) <= 2] if a != b]
    pairs = np.array(near, np.uint64).view(np.int64).tolist()
    assert groups(links) == groups(pairs)


def test_language_model(spark, odd, empty):
    docs = spark.createDataFrame([(k, long_text(k % 7, 40)) for k in range(40)], "doc_id bigint, text string")
    out = {r.id: r for r in lm.score_texts(docs, docs.doc_id % 5 != 1, PATH, PATTERN).collect()}
    counts = collections.Counter(w for k in range(40) if k % 5 != 1 for w in long_text(k % 7, 40).split())
    total, kinds = sum(counts.values()) + 32, len(counts) + 1
    for k, r in out.items():
        log = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in long_text(k % 7, 40).split())
        log += np.log10(32.5 / (total + 0.5 * (kinds + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (41, 41, total) and abs(r.base_score - log) < 1e-6
        assert r.score < 0
    assert lm.score_texts(odd, odd.doc_id == 8, PATH, PATTERN).count() == odd.count()
    assert lm.score_texts(empty, empty.doc_id == 8, PATH, PATTERN).count() == 0


def test_attention_scores_each_place_once_and_sums_to_one():
    r = np.random.default_rng(0)
    flat = lm.first_model(r.integers(1, 100, lm.CLASSES))
    for n in (1, lm.T - 1, lm.T, lm.T + 1, 3 * lm.T + 5):
        assert lm.windows(r.integers(0, 9, n).astype(np.uint8), 9)[2].sum() == n
    seen = r.integers(0, lm.CLASSES, (1, lm.T)).astype(np.uint8)
    every = np.array([lm.log_probs(flat, seen, np.full((1, lm.T), k, np.uint8))[0] for k in range(lm.CLASSES)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    later = seen.copy()
    later[0, lm.T // 2 :] = 0  # what comes later changes nothing before it
    target = r.integers(0, lm.CLASSES, (1, lm.T)).astype(np.uint8)
    a, b = lm.log_probs(flat, seen, target), lm.log_probs(flat, later, target)
    assert np.allclose(a[0, : lm.T // 2], b[0, : lm.T // 2], atol=1e-5)


def test_classes_tell_company_and_place_in_a_word():
    counts = np.array([*range(4000, 3000, -1), *[0] * 50, 7])
    begins = np.arange(1050) % 2 == 0
    near = np.full((lm.GROUPED, lm.NEAR), 1.0)
    for k in range(1000):  # two languages, of which subwords meet their own only
        near[k, k // 2 % 2 :: 2] = 40
    classes, shares, per_class = lm.classes_of(counts, near, begins)
    assert per_class.sum() == counts.sum() and classes[-1] == lm.CLASSES - 1
    assert np.allclose(np.bincount(classes, 10**shares)[np.unique(classes)], 1)
    for c in range(lm.SINGLE, lm.CLASSES - 1):
        held = np.flatnonzero(classes[:1000] == c)
        assert len(set(held % 2)) <= 1 and len(set(held // 2 % 2)) <= 1
    blank = lm.classes_of(counts * 0, near * 0, begins)
    assert np.isfinite(blank[1]).all()


def test_packing(spark, odd, empty):
    r = random.Random(6)
    rows = [(k, r.choice([1, 7, 100, 511, 513, 900, 4096, 5000, 9000])) for k in range(500)] + [(500, None), (501, 0), (None, 3)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int")).collect()
    bins, total = collections.defaultdict(list), collections.Counter()
    for x in out:
        bins[x.bin_id].append(x)
        total[x.id] += x.length
    assert total == {i: n for i, n in rows if n}
    for held in bins.values():
        held.sort(key=lambda x: x.offset)
        ends = np.cumsum([x.length for x in held])
        assert [x.offset for x in held] == [0, *ends[:-1]]
        assert held[0].capacity == min(c for c in packing.CAPACITIES if c >= ends[-1])
    assert packing.pack(empty).count() == 0
    counts = collections.Counter(r.randint(1, 60) for _ in range(300))
    free = []
    for n in sorted(counts.elements(), reverse=True):  # piece by piece
        fits = [k for k, f in enumerate(free) if f >= n]
        if not fits:
            free.append(64)
            fits = [len(free) - 1]
        free[min(fits, key=lambda k: free[k])] -= n
    grouped = packing.best_fit(counts, [64], dict.fromkeys(counts, 64))
    assert tally((64 - sum(a * b for a, b in c),) for m, c in grouped for _ in range(m)) == tally((f,) for f in free)


def test_rules_by_brute_force(spark, odd, empty):
    for r in adaptive_rules.measure(odd).collect():
        text = next(t for i, t in texts_of(odd) if i == r.id and len(WORD.findall(t)) == r.n_words)
        words, at = WORD.findall(text), collections.defaultdict(list)
        for k in range(len(words) - 7):
            at[tuple(words[k : k + 8])].append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.word_chars, r.n_repeat_words) == (sum(map(len, words)), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == sum(map(text.count, "#*$%&|<>"))
    verdicts = adaptive_rules.adaptive_quality(odd)
    assert verdicts.count() == odd.count()
    assert {r.kept for r in verdicts.where("n_words < 20").collect()} == {False}
    assert adaptive_rules.adaptive_quality(empty).count() == 0
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    sketch = adaptive_rules.sketches(spark.range(1, 1001).selectExpr("'k' AS g", *[f"id / 10 AS {m}" for m in adaptive_rules.MEASURES]), "g")
    for r in adaptive_rules.quantile(sketch, 0.75, "g").collect():
        assert r.rows == 1000 and 75 <= r.q <= 75 * adaptive_rules.WIDTH * 1.001


def test_adaptive_limits_reject_repetition_under_the_fixed_cutoff(spark):
    def lines(seed, n):
        words = long_text(seed, 12 * n).split()
        return [" ".join(words[12 * k : 12 * k + 12]) for k in range(n)]

    rows = [(k, "\n".join(lines(k, 20))) for k in range(300)]
    # A quarter of the lines again, one line again in a short text, a quarter of the words again inside lines.
    again, once = lines(1000, 24), lines(1001, 10)
    rows += [(1000, "\n".join(again + again[:3])), (1001, "\n".join(once + once[:1]))]
    many = lines(1002, 40)
    rows.append((1002, "\n".join(many + [f"x{k} {a} y{k} {b}" for k, (a, b) in enumerate(zip(many[:6:2], many[1:6:2]))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'a' AS source")
    found = {r.id: r for r in adaptive_rules.adaptive_quality(df).collect()}
    assert not any(r.base_failed for r in found.values())
    assert {k for k, r in found.items() if not r.kept} == {1000, 1002}


def test_limits_change_little_with_a_row(spark):
    """No step at the number of rows from which a group's own quantiles count."""
    r = random.Random(12)

    def limit_of(n):
        rows = [(k, " ".join("#" * (k % 3) + f"word{r.randint(0, 999)}" for _ in range(60)), "en", "big") for k in range(400)]
        rows += [(1000 + k, " ".join("###" + f"w{k}{j}" for j in range(60)), "en", "small") for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
        shared = adaptive_rules.shares(adaptive_rules.measure(df, "doc_id", "text", "lang", "source"))
        found = adaptive_rules.limits(shared, 0.75, adaptive_rules.SLACK, 200)
        return {x.source: x.symbol_share_limit for x in found.collect()}

    few, less, more, many = (limit_of(n)["small"] for n in (5, 199, 201, 390))
    assert few < less < many and abs(less - more) < 0.02 * less


def test_archives_go_to_the_default_file_system(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert warc.qualified(spark, f"file:{tmp_path}") == warc.qualified(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://cluster/")
    conf.set("fs.viewfs.mounttable.cluster.link./data", f"file://{tmp_path}")
    try:
        assert warc.qualified(spark.newSession(), "/data/warc") == "viewfs://cluster/data/warc"
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_packing_broadcasts_no_offsets(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "id % 77 AS n_tokens")
    assert "BroadcastHashJoin" not in packing.pack(df)._jdf.queryExecution().executedPlan().toString()
