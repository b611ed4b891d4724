import os

import pytest

from quietlines.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.mark.parametrize("text", ["a", " a", "It's 12 o'clock,\n\n  then", "中文 \U0001f600️!", "x" * 300, " " * 40 + "y ", "z" * 20_000])
def test_every_byte_of_every_piece_goes_through_the_machine(text, monkeypatch):
    with open(tokens.VOCABULARY, "rb") as f:
        vocabulary = tokens.Vocabulary(f.read())
    fed = []
    feed = tokens.Machine.feed
    monkeypatch.setattr(tokens.Machine, "feed", lambda self, part: fed.append(part) or feed(self, part))
    ids = vocabulary.encode(text)
    assert b"".join(fed) == text.encode() == b"".join(vocabulary.bytes_of[i] for i in ids)
    again, known = vocabulary.encode(text), len(fed)
    assert again == ids and (len(text) > 1000 or len(fed) - known <= 1)  # remembered pieces are not fed again
