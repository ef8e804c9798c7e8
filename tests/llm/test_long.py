"""Texts full of hits: time grows as the text does, and results are those of the plain rules."""

import random
import re
import time

import numpy as np
import pytest

from marginalia.llm import decontaminate, language, pii, rangecoder, toxicity


def growth(work, sizes=(2_000, 16_000)) -> float:
    """How much longer the larger size takes, as a multiple of its size; the least of three runs each."""
    took = []
    for n in sizes:
        runs = []
        for _ in range(3):
            start = time.process_time()
            work(n)
            runs.append(time.process_time() - start)
        took.append(max(min(runs), 1e-4))
    return took[1] / took[0] / (sizes[1] / sizes[0])


def lexicon() -> toxicity.Lexicon:
    samples = [("you are trash and scum", 1)] * 1 + [(f"you are trash {i}", 1) for i in range(40)] + [(f"a quiet day {i}", 0) for i in range(40)]
    return toxicity.fit(samples, exceptions=("trash can", "the trash bin"))


def test_toxicity_hits():
    lex = lexicon()
    assert "trash" in lex.weights
    r = random.Random(2)
    for _ in range(60):
        text = " ".join(r.choice(["trash", "can", "the", "bin", "x", "trash can", "the trash bin"]) for _ in range(30))
        machine, spared, found = lex.machine(), [], []
        for last, (size, weight) in machine.iter(toxicity.fold(text)):
            start, end = last + 1 - size, last + 1
            if not ((start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())):
                (spared if weight is None else found).append((start, end, weight))
        assert lex.hits(text) == [h for h in found if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
    assert growth(lambda n: lex.hits("trash can trash x " * n)) < 3


def test_decontamination_of_repeats():
    def work(n):
        index = decontaminate.Index.of([("i", "la " * n), ("j", "la li " * n)])
        return index.hits(decontaminate.words_of("la " * n + "li " * n))

    hit, found = work(100)
    assert found == {0} and hit[:100].all() and not hit[100:].any()
    assert growth(work) < 3


def test_decontamination_against_sets():
    r = np.random.default_rng(6)
    text = lambda n, of: " ".join(r.choice(list(of), n))
    for _ in range(40):
        items = [(str(k), text(int(r.integers(0, 60)), "ab")) for k in range(6)]
        doc = text(200, "abc") + " " + items[0][1] + " " + text(50, "ab")
        words = doc.split()
        want, who = np.zeros(len(words), bool), set()
        for k, (_, t) in enumerate(items):
            own = t.split()
            size = min(len(own), decontaminate.WINDOW)
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1) if own else []:
                if tuple(words[i : i + size]) in grams:
                    want[i : i + size] = True
                    who.add(k)
        hit, found = decontaminate.Index.of(items).hits(decontaminate.words_of(doc))
        assert (hit == want).all() and found == who


def test_spans_apart():
    r = random.Random(3)
    for _ in range(200):
        spans = lambda n: [("ip", a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(n))]
        extra, base = spans(12), spans(6)
        assert pii.apart(extra, base) == [s for s in extra if not any(s[1] < b and a < s[2] for _, a, b in base)]
    assert growth(lambda n: pii.apart([("ip", 9 * i, 9 * i + 4) for i in range(n)], [("ip", 9 * i + 5, 9 * i + 8) for i in range(n)])) < 3


@pytest.mark.parametrize("text, letters", [("² ½", False), ("Ⅷ ①", False), ("12 _ !", False), ("", False), ("é", True), ("5 ª", True), ("中", True), ("½ a", True)])
def test_letters(text, letters):
    assert language.has_letter(text) is letters
    if not letters:
        model = language.ByteConv.__new__(language.ByteConv)
        assert language.predict(model, [text]) == [("und", 0.0)]


def test_token_files_send_no_whole_texts_to_the_driver(spark):
    long = "same start " * 20
    rows = [(i % 7 if i % 3 else None, f"{'' if i % 2 else long}{i * 7919 % 1000}") for i in range(300)] + [(2, None), (2, ""), (2, long)]
    got = rangecoder.in_order(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    keys = re.findall(r"rangepartitioning\((.*)", got._jdf.queryExecution().executedPlan().toString())
    assert keys and not any(re.search(r"\btext#\d+ ASC", k) for k in keys)  # Spark samples keys: they hold how a text begins
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
    assert [tuple(r) for r in got.collect()] == sorted(rows, key=order)
