"""The tokenizer looks a word up once for some texts, however often it stands there."""

import numpy as np

from marginalia.llm.common import WordTokenizer, vocab_json
from marginalia.llm.counts import Counted, edit_all, revisions

ODD = [None, "", " ", "\n a  b\t", "x" * 300 + " y", "É È ß ÿ " + "".join(map(chr, range(0xA0, 0x100))), "<|endoftext|> a", " lead", "trail ", "日本 語", "é" * 150, "é a", "it's we'll o'clock's 'd", "ÀÁ<b>x", "z " * 5, "a" * 201, "é1é2,ÿ"]


def test_distinct_words_are_looked_up_once():
    tokens, asked = WordTokenizer(vocab_json()), []
    rows = tokens.rows
    tokens.rows = lambda words, *times: (asked.extend(words), rows(words, *times))[1]
    texts = ["the same, the same words " * 200, *ODD, "the same words"] * 2
    got = [x.tolist() for x in tokens.encode(texts)]
    assert got == [tokens.library_ids(t or "") for t in texts]
    assert len(asked) == len(set(asked))  # once each for every place where it stands
    assert tokens.uses[tokens.index["the"]] == 802


def test_spaces_and_long_runs_with_a_small_memo():
    tokens = WordTokenizer(vocab_json())
    tokens.MEMO, tokens.KEPT = 10, 4
    for _ in range(3):
        for t in ODD:
            assert next(tokens.encode([t])).tolist() == tokens.library_ids(t or "")
    assert tokens.index[""] == 0 and tokens.length[0] == 0


def test_new_pre_tokens_go_to_the_library_many_at_a_time():
    tokens = WordTokenizer(vocab_json())
    words = [f"{a}{b}{c}" for a in ("ba", "é", "zu") for b in ("ren", "ço", "ly") for c in ("", "ÿn", "tion")]
    text = ", ".join(words) + ". 2024?! it's"
    calls, inner = [], tokens.many

    class Many:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return inner.encode_batch_fast(texts, **how)

    tokens.many = Many()
    assert next(tokens.encode([text])).tolist() == tokens.library_ids(text)
    assert calls == [1] and "baren" in tokens.index and "baren," not in tokens.index  # a word's signs are a pre-token of their own
    tokens = WordTokenizer(vocab_json())
    tokens.last[:] = False  # a vocabulary without marks of a pre-token's end
    assert next(tokens.encode([text])).tolist() == tokens.library_ids(text)


def test_edits_of_some_texts_are_counted_together():
    tokens, asked = WordTokenizer(vocab_json()), []
    counts = tokens.counts
    tokens.counts = lambda texts: (asked.append(len(texts)), counts(texts))[1]
    texts = [*(f"text {i} " * (i + 1) for i in range(60)), *(t or "" for t in ODD)]
    held, plain = [Counted(t, tokens) for t in texts], list(texts)
    asked.clear()
    for k in range(4):
        edits = [revisions(len(t))[k] for t in texts]
        edit_all(held, edits, tokens)
        plain = [t[:a] + new + t[max(a, b) :] for t, (a, b, new) in zip(plain, edits, strict=True)]
    assert len(asked) == 4  # one call for each round of edits, not one for each edit
    assert [d.text for d in held] == plain and [d.n_tokens for d in held] == [len(tokens.library_ids(t)) for t in plain]


def test_few_words_do_not_go_through_the_memo():
    tokens, sizes = WordTokenizer(vocab_json()), []
    tokens.counts([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5_000))])
    bincount = np.bincount
    try:
        np.bincount = lambda x, *a, **how: (sizes.append(how.get("minlength", 0)), bincount(x, *a, **how))[1]
        used = tokens.uses[tokens.index["waaa"]]
        assert tokens.counts(["waaa waaa, don't", ""]) == [len(tokens.library_ids("waaa waaa, don't")), 0]
    finally:
        np.bincount = bincount
    assert max(sizes) < 10 and tokens.uses[tokens.index["waaa"]] == used + 2
