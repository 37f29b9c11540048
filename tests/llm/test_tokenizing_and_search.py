"""The tokenization automaton against its library, lexical search against brute force."""

import collections
import json
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from conftest import DATA
from tabflow.llm import lexical_search, merge_automaton
from tabflow.llm.queries import QUERIES, SQL
from test_oracle import FOLDER, duck, ordered  # noqa: F401

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def coder():
    return merge_automaton.Encoder(PATH, PATTERN)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def one(coder, text):
    counts, found = coder.encode([text])
    assert counts.tolist() == [len(found)]
    return found.tolist()


@pytest.mark.parametrize("letters", ["ab", "aA ", "etaoin shrdlu", "éüаб漢😀ñ ", " \n\t　\x85\x1cx1'", "0123456789.,-", "=-_#*"])
def test_automaton_is_exact(coder, library, letters):
    r = random.Random(letters)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(500)]
    for text in [*texts, letters[0] * 5000, letters * 300]:
        assert one(coder, text) == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text(coder, library):
    for text in ("\0<|endoftext|>", "\0 <|endoftext|>\0", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x <|endoftext|>\n"):
        assert one(coder, text) == library.encode(text, add_special_tokens=False).ids


def by_merging(merges, word):
    """Each merge in turn, from left to right over the whole word."""
    parts = list(word)
    for a, b in merges:
        k = 0
        while k + 1 < len(parts):
            if parts[k] == a and parts[k + 1] == b:
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


def test_small_automata_of_any_merges(tmp_path):
    """Also merges of a token with itself, and merges whose tokens can never meet."""
    letters = merge_automaton.byte_letters()
    for seed in range(30):
        r, tokens, merges = random.Random(seed), list("abc"), []
        while len(merges) < 12:
            pair = (r.choice(tokens), r.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        vocab = {t: k for k, t in enumerate([*letters, *tokens[3:]])}
        whole = {
            "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]},
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False},
            "normalizer": None,
            "added_tokens": [],
        }
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(whole))
        own = merge_automaton.Automaton(merge_automaton.Merges(str(path)))
        words = ["".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(200)]
        words.append("".join(r.choice("abc") for _ in range(200)))
        counts, tokens = own.encode([w.encode() for w in words])
        parts = [[vocab[t] for t in by_merging(merges, w)] for w in words]
        assert counts.tolist() == list(map(len, parts))
        assert tokens.tolist() == sum(parts, [])


def test_a_forgotten_table_is_begun_anew(library):
    own = merge_automaton.Encoder(PATH, PATTERN)
    own.KEEP, own.automaton.KEEP_STEPS, own.PIECE = 3, 20, 10
    texts = ["The automaton forgets, and the results stay the same. " * 3, "", "x" * 300, "<|endoftext|>\0"]
    counts, tokens = own.encode(texts)
    want = [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert counts.tolist() == list(map(len, want)) and tokens.tolist() == sum(want, [])


def test_a_table_too_small_for_one_call_grows(library, coder):
    own = merge_automaton.Encoder(PATH, PATTERN)
    own.automaton.PLACES = 64
    own.automaton.forget()
    r = random.Random(5)
    text = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 90))) for _ in range(200))
    assert one(own, text) == library.encode(text, add_special_tokens=False).ids
    assert own.automaton.places > 64


def test_files_of_another_kind_raise():
    with pytest.raises(ValueError):
        merge_automaton.Merges(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n", "A b!", "A b!", "a-b a_b A", "é1 É1 x　y", "end", "b " * 4000 + "a", "zz zz"]
    rows = [(None if k == 9 else min(k, 7), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", "1 AS id", "2 AS term", "3 AS score", "4 AS item", "5 AS ids")


def test_encode_and_decode_columns(odd, library):
    coded = merge_automaton.automaton_decode(merge_automaton.automaton_encode(odd, PATH, PATTERN), PATH)
    got = [(r.id, r.n_tokens, ids(r.ids), r.decoded) for r in coded.collect()]
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = [(i, library.encode(t, add_special_tokens=False).ids, t) for i, t in texts]
    assert sorted(map(str, got)) == sorted(str((i, len(x), x, t)) for i, x, t in want)
    both = merge_automaton.automaton_encode(odd, PATH, PATTERN, decoded=True)
    assert both.exceptAll(coded).count() == 0 and both.columns == coded.columns
    assert merge_automaton.automaton_encode(odd.limit(0), PATH, PATTERN).count() == 0


def brute(docs, items, most):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {k: k + 32 for k in range(65, 91)}
    terms = [(i, collections.Counter(word.findall((t or "").translate(lower)))) for i, t in docs]
    terms = [x for x in terms if x[1]]
    total = sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(t for _, c in terms for t in c)
    of = collections.defaultdict(set)
    for item, text in items:
        of[item] |= set(word.findall((text or "").translate(lower)))
    out = []
    for item, asked in of.items():
        found = []
        for i, c in terms:
            m = 100 - 50 + (50 * sum(c.values()) * len(terms)) // total
            score = 0
            for t in asked & set(c):
                weight = math.floor(1000 * math.log((2 * len(terms) + 2) / (2 * df[t] + 1)))
                score += weight * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_search_matches_brute_force(spark, odd, block_bytes):
    items = [(1, "a B, é1!"), (2, None), (3, "nothing here"), (4, "zz b"), (4, "end"), (None, "A"), (5, "")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for most in (1, 2, 50):
        got = lexical_search.search(odd, asked, most, block_bytes=block_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, most)
    assert lexical_search.search(odd.limit(0), asked).count() == 0
    assert lexical_search.search(odd, asked.limit(0)).count() == 0


def test_ties_beyond_the_best(spark, monkeypatch):
    """Many equal documents: the smallest ids stay, also when a task forgets worse ones."""
    monkeypatch.setattr(lexical_search.Best, "ROOM", 10)
    docs = [(k, "same words here" if k % 3 else f"same {k}") for k in range(3000, 0, -1)]
    items = [(k, "words same") for k in range(3)]
    got = lexical_search.search(
        spark.createDataFrame(docs, "doc_id int, text string"),
        spark.createDataFrame(items, "item_id int, text string"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 50)


def test_blocks_keep_to_their_size(spark):
    items = spark.createDataFrame([(k, f"word{k} common") for k in range(50)], "item_id int, text string")
    terms = lexical_search.item_terms(items, "item_id", "text")
    assert lexical_search.blocks_of(terms, 10_000) == 1
    assert lexical_search.blocks_of(terms, 200) >= 8
    assert lexical_search.blocks_of(terms, 1) < 1 << 20


def test_query_of_lexical_search_matches_sql(spark, duck):  # noqa: F811
    result = QUERIES["op13_lexical_search"](spark, str(FOLDER))
    expected = duck.execute(SQL["op13_lexical_search"])
    names = [d[0] for d in expected.description]
    got = ordered(result.collect(), [result.columns.index(c) for c in names])
    assert got == ordered(expected.fetchall(), range(len(names)))


def test_query_of_automaton_matches_library(spark, library):
    import hashlib

    folder = str(DATA / "sf0.001")
    got = {r.doc_id: r for r in QUERIES["op12_merge_automaton"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want = np.array(library.encode(row.text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(want).hexdigest()
        assert got[row.doc_id].n_tokens == len(want) // 4
        text = library.decode(ids(want), skip_special_tokens=False)
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
