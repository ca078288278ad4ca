import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.functions import forms as f


def slow_form(text):
    text = "".join(c for c in text or "" if unicodedata.category(c) != "Cf")
    text = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text).split(" ")).split()


def test_word_pattern_is_letters_and_numbers():
    assert all(bool(re.match(r"[^\W_]", chr(c))) == (unicodedata.category(chr(c))[0] in "LN") for c in range(0x110000))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_form(text):
    assert f.words(text) == slow_form(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text())))
def test_forms_of_a_batch(texts):
    assert f.forms(texts) == [f.form(t) for t in texts]


def test_form_cases():
    assert f.form(None) == f.form("") == f.form(" -- ") == ""
    assert f.form("A_b-C") == "a b c"
    assert f.form("Straße ­X") == "strasse x"
    assert f.form("ﬁne") == "fine"
    assert f.form("é") == f.form("é")
    assert f.form("x" * 200_000) == "x" * 200_000
    assert f.forms([]) == []


def test_grams_of_a_batch():
    texts = ["", "abc", "abcde", "abcdef", "abcdeabcde", "中文字符串测试"]
    keys, n = f.grams_of(texts)
    assert n.tolist() == [0, 1, 1, 2, 6, 3]
    assert np.array_equal(keys, np.concatenate([f.gram_hashes(t) for t in texts]))
    assert len(set(f.gram_hashes("abcdeabcde").tolist())) == 5
    assert len(f.grams_of(["", "ab"])[0]) == 1


def slow_tokens(text):
    n, before = 0, False
    for c in text or "":
        kind = unicodedata.category(c)
        if kind in ("Cc", "Cf") and not c.isspace() or c == "�":
            continue
        ideograph = any(a <= ord(c) <= b for a, b in f.IDEOGRAPHS)
        word = kind[0] in "LN" and not ideograph
        n += ideograph or (word and not before) or not (word or c.isspace() or kind[0] == "Z")
        before = word
    return n


def test_token_counts():
    rng = random.Random(5)
    texts = ["", None, "a b", "ab中文c d", "it's", "x­y", "­", "\t \n", "1,000.5"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3100), rng.randrange(0x4E00, 0x9FFF), 32, 0x200B])) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert f.token_counts(pa.array(texts, pa.string())).tolist() == [slow_tokens(t) for t in texts]
    assert [len(f.token_starts(t or "")) for t in texts] == [slow_tokens(t) for t in texts]
    assert f.token_counts(pa.array([], pa.string())).tolist() == []
