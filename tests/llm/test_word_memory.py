"""Words of the tokenizer and of the phrases: short ways give what the long ones do."""

import public_tokenizers
import pyarrow as pa

from tillspark.llm import bpe


def test_a_chunk_of_one_word_is_remembered_once():
    vocabulary = bpe.merger(bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json")))
    encoder = bpe.Encoder(vocabulary)
    text = "one two three, two one. three"
    assert encoder.decode(encoder.encode(text)) == text
    assert {"two", "three,", "three", "one."} <= set(encoder.chunks)
    assert not {" two", " three", " one"} & set(encoder.words)
    assert encoder.decoded(encoder.encode("é x")) == "é x".encode()


def test_words_are_counted_as_the_pattern_cuts_them():
    texts = ["one two, two. x1 's  a\n b", " lead", "", None, "trail ", "é é, ,. ."]
    want = {}
    for t in texts:
        for w in bpe._PATTERN.findall(t or ""):
            want[w] = want.get(w, 0) + 1
    # Chunks are cut at blanks, so white space that meets a blank counts apart.
    got = {}
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for b in bpe._count_words(iter([batch])):
        got |= dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    assert {w: n for w, n in got.items() if not w.isspace()} == {
        w: n for w, n in want.items() if not w.isspace()}


def test_words_and_extensions_by_language():
    from tillspark.llm import collocations as co
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en", "de", None, "en"]),
         pa.array(["A b\ta b, a", "a b a\rc", "a", "\x01\x00 x"])], names=["lang", "text"])
    rows = lambda run: {k: n for b in run for k, n in zip(
        b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert rows(co._count_words(iter([batch]))) == {
        b"en\x00a": 3, b"en\x00b": 2, b"en\x00\x01\x02\x01\x01": 1, b"en\x00x": 1,
        b"de\x00a": 2, b"de\x00b": 1, b"de\x00c": 1, b"und\x00a": 1}
    assert rows(co._extensions({b"en\x00a"})(iter([batch]))) == {
        b"en\x00a\x00b": 2, b"en\x00a": 1}
    assert rows(co._extensions({b"en\x00a\x00b", b"de\x00b\x00a"})(iter([batch]))) == {
        b"en\x00a\x00b\x00a": 1, b"en\x00a\x00b": 1, b"de\x00b\x00a": 1}
