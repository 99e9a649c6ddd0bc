import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from outcome_engine.llm.encoding import AtomEncoder

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ENCODERS = {k: AtomEncoder(public_tokenizers.path(f), k) for k, f in FILES.items()}
ODD = ["", " ", "\n", "a\x1cb  c \n\n d e  \n", "a \n b", "don't 'S it's  x<|endoftext|> y", "é ́a", "ΑΣ ΑΣ. ab",
       "a b   c\x85d\x0b\x0c", "  lead", "trail  ", "ab.\nCd ef!!\nGh", "İstanbul, ǅ. ﬁ", "x\x01y \x01 z", "a.,;b c!'s ,.", "é, é. 12 3a."]
PIECES = st.lists(st.sampled_from([*"abZé.,'!# \n\t0Σ́ \x1c\x01", "the", " the", "'s", ". ", ",\n"]), max_size=30).map("".join)


def agree(kind, texts):
    e = ENCODERS[kind]
    ids, sizes = e.encode(texts)
    whole = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [i for x in whole for i in x]
    assert sizes.tolist() == [len(x) for x in whole]


@pytest.mark.parametrize("kind", FILES)
def test_odd_texts_encode_as_in_one_call(kind):
    agree(kind, [*ODD, None])


@pytest.mark.parametrize("kind", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(PIECES | st.text(max_size=20), max_size=4))
def test_any_texts_encode_as_in_one_call(kind, texts):
    agree(kind, texts)


def test_end_id_and_forgotten_cache():
    e = AtomEncoder(public_tokenizers.path(FILES["word"]), "word", max_atoms=2)
    for _ in range(3):
        ids, sizes = e.encode(["one two three", None, "four"], end=1)
        assert sizes.tolist() == [4, 1, 2] and ids[[3, 4, 6]].tolist() == [1, 1, 1]


@pytest.mark.parametrize("kind", FILES)
def test_many_new_words_take_few_calls_and_one_lookup_each(kind):
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def __getattr__(self, name):
            def call(texts, **kw):
                self.texts += len(texts)
                return getattr(self.tokenizer, name)(texts, **kw)
            return call

    class Places(dict):
        looked_up = 0

        def get(self, *args):
            Places.looked_up += 1
            return super().get(*args)

    e = AtomEncoder(public_tokenizers.path(FILES[kind]), kind)
    plain, e.place, e.tokenizer = e.tokenizer, Places(), Counted(e.tokenizer)
    words = [f"{a}{b}{c}" for a in "bcdfgé" for b in "aeiou" for c in ("x'yz", "word,", "l日", "n9.!", "st")]
    texts = [" ".join(words[i:] + words) for i in range(0, len(words), 10)]
    ids, sizes = e.encode(texts)
    whole = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in whole for i in x]
    assert sizes.tolist() == [len(x) for x in whole]
    assert e.tokenizer.texts < 30
    assert Places.looked_up < 2 * len(words)
