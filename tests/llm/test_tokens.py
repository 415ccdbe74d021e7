import random

from rosterlane.llm.tokens import Encoder, count_tokens, op3_token_counts, tokenizer_file, whole_tokens
from tests.llm import cases
from tokenizers import Tokenizer


def check(rows, docs):
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    expect = []
    for i, text in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        expect.append((i, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, rows), key=repr) == sorted(expect, key=repr)


def texts():
    rng = random.Random(3)
    parts = ["don't", "'tis", " 's", "''s", "'", " ", "  ", "\n", "\t\n ", "12a3", "é", "ǅ", "ΣΑΣ", "İx", "½", "ª", "́e", "é", "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "​", "\xa0", "\x85", "\x1c", "we'LL", "I'd've", "...", "word", "\x00", "＇s", "　", "ꟑ", "'re", "'rex", "'l", "x'"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]


def test_query_against_the_library(spark, sf_dir):
    check(op3_token_counts(spark, sf_dir).collect(), cases.corpus(spark, sf_dir))


def test_both_ways_equal_the_library_on_odd_texts():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        data = open(tokenizer_file(name)).read()
        e, t = Encoder(data, whole_tokens(data)), Tokenizer.from_str(data)
        odd = texts()
        assert e.counts(odd).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in odd]
        assert len(e.plain(odd)[0]) > 300


def test_awkward_rows(spark):
    df = cases.frame(spark, ["n_tokens"])
    check(count_tokens(df, tokenizer_file("word_bpe_49k.json")).collect(), [(r[0], r[1]) for r in cases.rows()])
    assert count_tokens(cases.empty(spark), tokenizer_file("word_bpe_49k.json")).count() == 0


#: Found by lattice reduction: the sums of (code point + 0x51ED27) * 0x9E3779B97F4A7C15**i agree modulo 2**64.
SHORT_TWINS = [("deaaaaaeaacaaabcaabaac", "aacadadabaadbcaaebadaa"), ("abbabaacaacaaabbbaaaacaaaadb", "aaabaaaacaabcaaaacbadaaabdaa")]


def twins(n=4096):
    """Two words that every polynomial hash modulo 2**64 takes for one."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_hash_confuses():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        data = open(tokenizer_file(name)).read()
        e, t = Encoder(data, whole_tokens(data)), Tokenizer.from_str(data)
        for x, y in [*SHORT_TWINS, twins()]:
            for texts in ([x, y, f"one {x} and {y}"], [y, x]):
                assert e.counts(texts).tolist() == [len(t.encode(s, add_special_tokens=False).ids) for s in texts]
