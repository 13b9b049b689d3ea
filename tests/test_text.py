import hashlib
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ashlar.functions import text
from ashlar.functions.text import (
    ALPHABET,
    digest_text,
    field_count,
    lenient_double,
    look_alike,
    parsed_double,
    readable_label,
    unquote,
)


def apply(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def plain_unquote(text):
    out, quoted = [], False
    for char in text:
        if char in "'\"":
            quoted = not quoted
            out.append(" ")
        else:
            out.append("_" if char == "," and quoted else char)
    return "".join(out)


def plain_look_alike(text):
    out = []
    for i, char in enumerate(text):
        start = i // 16 * 16
        byte = (hashlib.md5(text[start : start + 16].encode()).digest()[i % 16] + 128) % 256
        for low, high, size in (("A", "Z", 26), ("a", "z", 26), ("0", "9", 10)):
            if low <= char <= high:
                char = chr(ord(low) + byte % size)
                break
        out.append(char)
    return "".join(out)


LINES = ["", "a,b", 'a,"x,y",O\'k,b', "'", "a,b,,", '"a,\'b,c",d', "no quotes at all, but commas,"]


def test_unquote_follows_the_definition(spark):
    assert apply(spark, LINES, unquote) == [plain_unquote(t) for t in LINES]


def test_unquote_example(spark):
    assert apply(spark, ['a,"x,y",O\'k,b'], unquote) == ["a, x_y ,O k_b"]


def test_field_count_keeps_trailing_blanks(spark):
    assert apply(spark, LINES, field_count) == [t.count(",") + 1 for t in LINES]
    assert apply(spark, ["é,ü,\U0001f600"], field_count) == [3]


def test_lenient_numbers(spark):
    texts = ["1e5", " 3 ", "", "abc", ".5", "5.", "-2.5E-3", "+7", "1d", "2024-01-01", "1,5", "e5", ".", None, "0x", "12abc"]
    expected = [1e5, 3.0, 0.0, 0.0, 0.5, 5.0, -0.0025, 7.0, 1.0] + [0.0] * 7
    assert apply(spark, texts, lenient_double) == expected


def test_number_pattern_hides_no_finite_number_from_the_cast(spark):
    texts = ["1", "-1", "1.", ".1", "1e3", "1E-3", "1f", "1D", "\t1\n", "x", "1 2", "--1", "1e", "nand", "0x1p3"]
    guarded = apply(spark, texts, parsed_double)
    plain = apply(spark, texts, lambda t: t.try_cast("double"))
    assert repr(guarded) == repr(plain)


def test_words_for_what_is_no_number(spark):
    assert apply(spark, ["NaN", "nan", "Infinity", "-inf", " Inf "], parsed_double) == [None] * 5


def test_look_alike_at_chunk_borders(spark):
    texts = ["", "a", "x" * 15, "y" * 16, "z" * 17, "Q7" * 18, "Éa1\U0001f600b" * 7, "Dr. No, 42!\n", "0123456789" * 5]
    assert apply(spark, texts, look_alike) == [plain_look_alike(t) for t in texts]


@pytest.mark.parametrize("window", [130, 193, 1 << 19])
def test_look_alike_at_window_borders(monkeypatch, window):
    monkeypatch.setattr(text, "WINDOW", window)
    shapes = ["", "a1B" * 50, None, "\U0001f600" * 41, "É" * 33 + "z9", "x" * 16, "y" * 130, "", "w" * 129, "Q"]
    texts = [t and t + "k" * (n % 19) for n in range(40) for t in shapes]
    expected = [None if t is None else plain_look_alike(t) for t in texts]
    assert text._substituted(pa.array(texts), b"").to_pylist() == expected
    assert text._substituted(pa.array(["ab", *texts])[1:], b"").to_pylist() == expected


def test_look_alike_holds_little_beside_a_batch():
    batch = pa.array(["some Words and 12 numbers " * 400] * 800)
    tracemalloc.start()
    text._substituted(batch, b"")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * batch.nbytes


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=60), min_size=20, max_size=40))
def test_text_functions_on_any_text(spark, texts):
    assert apply(spark, texts, look_alike) == [plain_look_alike(t) for t in texts]
    assert apply(spark, texts, unquote) == [plain_unquote(t) for t in texts]


def test_look_alike_salt(spark):
    texts = ["Ann Lee, 7", "Ann Lee, 7", "a longer text of some 40 characters, Bob"]
    plain, one, two = (apply(spark, texts, lambda c, s=s: look_alike(c, s)) for s in ("", "one", "two"))
    assert plain == apply(spark, texts, look_alike) and one[0] == one[1]
    assert len({plain[0], one[0], two[0]}) == len({plain[2], one[2], two[2]}) == 3


def test_look_alike_keeps_shape_and_equality(spark):
    one, two, three = apply(spark, ["Ann Lee, 7", "Ann Lee, 7", "Ann Lee, 8"], look_alike)
    assert one == two != three
    for before, after in zip("Ann Lee, 7", one):
        assert before.isupper() == after.isupper() and before.islower() == after.islower()
        assert before.isdigit() == after.isdigit()


def test_readable_labels(spark):
    def label(text):
        return readable_label(digest_text(text), F.lit(13), 13)

    for text, made in zip("abcdefgh", apply(spark, list("abcdefgh"), label)):
        digest = hashlib.md5(text.encode()).digest()
        index = [b & 31 for b in digest[:13]]
        index[0] -= 24 if index[0] > 23 else 0
        assert made == "".join(ALPHABET[i] for i in index)
        assert made[0].isalpha()
