import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm import tokenizer

library = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = library.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.encoder(tokenizer.default_ranks())


SAMPLES = ["Hello world", "I'll  say\n\n 's ½ 12³  x_y", "<|endoftext|> a", "a" * 3000, " " * 500 + "x ", "ſtolen ﬁne é", "\x1c\x1d\u0085  ​", "Поезд в селе", "日本語テキスト🛡️"]


def test_samples(encoder, reference):
    for s in SAMPLES:
        assert encoder.encode(s) == reference(s), s
    assert encoder.encode("") == encoder.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=20, unique=True), st.binary(max_size=25).map(lambda b: bytes(x % 4 for x in b)))
def test_suffix_automaton(tokens, text):
    """The tokens that are suffixes of each prefix, the longest first."""
    automaton = tokenizer.SuffixAutomaton({t: k for k, t in enumerate(tokens)})
    automaton.open()
    got = [list(x) for x in automaton.suffixes(text)]
    assert got == [sorted(((len(t), k) for k, t in enumerate(tokens) if text[:end].endswith(t)), reverse=True) for end in range(1, len(text) + 1)]


def test_store_of_pieces_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(tokenizer, "KEPT_PIECES", 10)
    own = tokenizer.Encoder(tokenizer.default_ranks())
    text = " ".join(f"word{k}" for k in range(50))
    assert own.encode(text) == encoder.encode(text) and len(own) <= 10


def test_column(spark, encoder):
    rows = [(1, "Hello"), (2, ""), (3, None), (None, "x"), (1, "Hello")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in tokenizer.encode_column(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted(((k, encoder.encode(t)) for k, t in rows), key=repr)
    assert tokenizer.encode_column(df.limit(0), "doc_id", "text").count() == 0
