"""Words give the ids that texts give."""

import pyarrow as pa

from frameloom.llm import packing
from frameloom.llm.queries import tokenizer_path


def test_words_give_the_ids_of_texts():
    words = packing.Words(tokenizer_path("word_bpe_49k.json"))
    marks = ["a, b. c! d?", "x1, é; Z:", "it's, don't. I'LL!", "end.", ",", " ,.", "a,b, c ,d", "ab,\u0301 c", "e\u0301, f.", "A\x0bb,\x0cc", "a,\xa0b,\u2003c", "é.\x1cé.", "1.5, 2:3; 4"]
    special = ["<|endoftext|>", "a<|startoftext|>b, c", "<|endoftext|>, <|x|>", "<|END OFTEXT|>"]
    texts = ["", None, " ", "ΣΑΣ, İstanbul. ß", "日本, 語. z", "long" * 40 + ", " + "x" * 90, *marks, *special] * 2
    ids, at = words.ids(pa.array(texts), 0)
    told = words.pieces.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*e.ids, 0] for e in told]
    assert words.ids(pa.array([], pa.string()), 0)[1].tolist() == [0]
