import hashlib
import random
from itertools import groupby

import numpy as np
import pyarrow as pa
from rosterlane.llm import lexicon
from rosterlane.llm.lexicon import Lexicon, automaton, build_lexicon, compiled, decode, decode_ids, encode, encode_texts, op12_bpe_lexicon, token_bytes
from rosterlane.llm.tokens import Encoder, tokenizer_file
from tests.llm import cases
from tests.llm.test_tokens import SHORT_TWINS, texts, twins
from tokenizers import Tokenizer

FILE = tokenizer_file("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def opened(tmp_path, words):
    (tmp_path / "lexicon").write_bytes(compiled(words))
    return Lexicon(str(tmp_path / "lexicon"))


def random_words(n, seed=5):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices("abé", k=rng.randint(1, 6))) + rng.choice(["", "s", "ing", "ings"]) for _ in range(n)})


def test_the_automaton_is_minimal_and_numbers_all_words(tmp_path):
    words = random_words(600)
    arcs, final, order = automaton(sorted(w.encode() for w in words))
    accepted: dict[int, frozenset] = {}
    for s in order:  # the words that can be finished from each state
        accepted[s] = frozenset(([b""] if final[s] else []) + [bytes([b]) + rest for b, t in arcs[s].items() for rest in accepted[t]])
    assert accepted[0] == {w.encode() for w in words}
    assert len(set(accepted.values())) == len(order)  # no two states are alike
    held = opened(tmp_path, {w.encode(): [i, i + 1] for i, w in enumerate(words)})
    strings = [*words, "", "a" * 99, "zz", "abx", "日"]
    number = held.find(pa.array(strings, pa.large_string()))
    assert sorted(number[: len(words)].tolist()) == list(range(len(words))) and (number[len(words) :] == [n if w in words else -1 for w, n in zip(strings[len(words) :], number[len(words) :], strict=True)]).all()
    for w, n in zip(words, number.tolist(), strict=False):
        assert held.ids[held.low[n] : held.low[n + 1]].tolist() == [words.index(w), words.index(w) + 1]
    assert held.find(pa.array([], pa.large_string())).tolist() == []
    assert opened(tmp_path, {}).find(pa.array(["a", ""], pa.large_string())).tolist() == [-1, -1]


def test_encoding_equals_the_library_with_and_without_the_lexicon(tmp_path):
    data = open(FILE).read()
    odd = [*texts(), *twins(), *SHORT_TWINS[0], "", "the the of and"]
    some = {w: LIBRARY.encode(w, add_special_tokens=False).ids for w in (" the", "the", " and", "word", "...")}
    for held in ({}, {w.encode(): i for w, i in some.items()}):
        ids, lengths = encode_texts(Encoder(data), opened(tmp_path, held), odd)
        at = np.concatenate(([0], np.cumsum(lengths)))
        for k, x in enumerate(odd):
            assert ids[at[k] : at[k + 1]].tolist() == LIBRARY.encode(x, add_special_tokens=False).ids


def test_decoding_equals_the_library_on_any_ids():
    table, rng = token_bytes(open(FILE).read()), random.Random(6)
    lists = [[rng.randint(0, 50256) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    lists += [[50256, 1, 50256], [99999, 5], [-1], []]
    lists += [[LIBRARY.encode("日", add_special_tokens=False).ids[0]]]  # a part of a character
    sizes = np.array([len(x) for x in lists])
    got = decode_ids(table, np.array([i for x in lists for i in x], np.int64), sizes).to_pylist()
    assert got == [LIBRARY.decode([i for i in x if 0 <= i <= 50256], skip_special_tokens=False) for x in lists]


def expected(rows):
    out = []
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


def test_query_against_the_library(spark, sf_dir):
    assert sorted(map(tuple, op12_bpe_lexicon(spark, sf_dir).collect()), key=repr) == expected(cases.corpus(spark, sf_dir))


def test_awkward_rows_and_whole_texts_back(spark):
    df = cases.frame(spark, ["ids", "n_tokens"])
    name = build_lexicon(df, FILE, size=50)
    rows = decode(encode(df, FILE, name), FILE, together=1000).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((r[0], r[1] or "") for r in cases.rows()), key=repr)
    assert [r.ids for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)) if r.doc_id == 7] == [LIBRARY.encode(cases.rows()[7][1], add_special_tokens=False).ids]
    none = cases.empty(spark)
    assert decode(encode(none, FILE, build_lexicon(none, FILE)), FILE).count() == 0


def test_the_lexicon_takes_whole_buckets_of_the_most_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(100)] + [("x" * 65, 10**6), ("", 9)], "word string, n long")
    for size in (0, 5, 10, 35, 100, 1000):
        got = {w: 1 + int(w[1:]) // 10 for w in lexicon.frequent_words(counts, size)}
        assert len(got) <= size
        assert all(n in got.values() for n in range(min(got.values(), default=99), 11)) and all(len(list(g)) == 10 for _, g in groupby(sorted(got.values())))
    assert len(lexicon.frequent_words(counts, 1000)) == 100
