"""BPE over distinct words against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import word_bpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
#: Cases of letters, marks, digits of other scripts, blanks and control characters, added tokens, and parts of them.
POOL = [*"abcDEF'sS tT 12 \n\t\x1c\x1f\x00\x85é́ΣσςİıßŁ漢字あ한́̈ẞ۱٣​ 🙂<|>_-.", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "Ᲊ", "ͅ", "\U00010d50"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own_ids(encoder, text):
    return [int(i) for blank_word in encoder.blank_words(text) for word in encoder.words(blank_word) for i in encoder.ids(word)]


def test_words_of_any_characters():
    encoder, rng = word_bpe.WordEncoder(PATH), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(POOL, k=rng.randint(0, 25)))
        assert own_ids(encoder, text) == library_ids(text), repr(text)


def test_every_character():
    """Each code point between two letters: classes, normal forms and cases are the library's own."""
    encoder, chars = word_bpe.WordEncoder(PATH), [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 500):
        text = "".join(f"A{c}b {c}{c}1 " for c in chars[k : k + 500])
        assert own_ids(encoder, text) == library_ids(text), hex(ord(chars[k]))


def test_long_words_take_no_square_of_time():
    encoder = word_bpe.WordEncoder(PATH)
    for text in ("x" * 60_000, "abcd" * 20_000, "漢" * 20_000):
        assert own_ids(encoder, text) == library_ids(text)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        word_bpe.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(1, "one two two", "a", 9), (1, "one two two", "a", 9), (None, "Two  ONE", None, 1), (2, "", "b", 2), (3, None, "c", None), (4, long, "d", 4), (5, long + " rare", "e", 5), (6, "\n\t", "f", 6)]


SCHEMA = "doc_id long, text string, at string, ids int"  # names that the operator makes too


@pytest.mark.parametrize("most_bytes", [0, 60, 1 << 20])
def test_encode_texts_odd_rows(spark, most_bytes):
    """With no frequent words at all, with a few, and with all of them."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    found = word_bpe.encode_texts(df.repartition(3), PATH, back="back", most_bytes=most_bytes)
    assert found.columns == ["doc_id", "at", "ids", "back"]
    assert {r["at"]: r.back for r in found.collect()} == {at: LIBRARY.decode(library_ids(t), skip_special_tokens=False) for _, t, at, _ in odd_rows()}
    key = lambda r: (repr(r[0]), repr(r[1]))
    want = sorted(((i, at, library_ids(t)) for i, t, at, _ in odd_rows()), key=key)
    lists = found.select("doc_id", "at", word_bpe.unpacked(F.col("ids")).alias("ids"))
    assert sorted(((r.doc_id, r["at"], r.ids) for r in lists.collect()), key=key) == want
    back = found.select("at", word_bpe.decoded(F.col("ids"), PATH).alias("t")).collect()
    assert {r["at"]: r.t for r in back} == {at: LIBRARY.decode(library_ids(t), skip_special_tokens=False) for _, t, at, _ in odd_rows()}


def test_encode_texts_of_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert word_bpe.encode_texts(none, PATH).count() == 0
    nulls = spark.sql("SELECT CAST(NULL AS binary) AS ids")
    row = nulls.select(word_bpe.decoded(F.col("ids"), PATH).alias("t"), word_bpe.unpacked(F.col("ids")).alias("a")).first()
    assert row.t == "" and row.a == []


def test_word_table_holds_each_word_once(spark):
    df = spark.createDataFrame([(k, "the cat" if k % 3 else "The cat's hat") for k in range(300)], "doc_id long, text string").repartition(5)
    found = {r.word: (r.n, list(np.frombuffer(r.ids, "<u2"))) for r in word_bpe.word_table(df, PATH).collect()}
    assert found == {w: (n, library_ids(w)) for w, n in (("the", 300), ("cat", 300), ("'s", 100), ("hat", 100))}
    words = word_bpe.word_table(df, PATH)
    for most, held in ((10, set()), (30, {"the", "cat"}), (1000, set(found))):
        frequent, others = word_bpe.frequent_words(words, most)
        assert {r.word for r in others.collect()} == set(found) - held and len(frequent) == len(held) and frequent.alone == (most == 1000)
        ids = dict(zip(found, frequent.of(list(found))))
        assert all(list(np.frombuffer(ids[w], "<u2")) == found[w][1] if w in held else ids[w] is None for w in found)


def test_op11_on_documents(spark):
    found = {r.doc_id: r for r in word_bpe.op11(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library_ids(r.text)
        back = LIBRARY.decode(ids, skip_special_tokens=False).encode()
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest())
        assert (found[r.doc_id].n_tokens, found[r.doc_id].ids_sha256, found[r.doc_id].decoded_sha256) == want
