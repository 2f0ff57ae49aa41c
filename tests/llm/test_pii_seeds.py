"""The tagger reads the windows that a plausible span can lie in, and finds what it finds in whole texts."""

import random

import numpy as np

from microtide.llm import pii


def texts(r, n):
    marks = ["@", " at ", "(AT)", "12", "7", "4111_1111_1111_1111", "10[.]0[.]0[.]1", "(030) 1234-5678", "ann at mail dot example dot org", "x@y.org", "\n", "été", "ßß"]
    return ["", "no marks here"] + ["".join(r.choice(marks) if r.random() < 0.03 else r.choice("abc de. fg,") for _ in range(r.randint(1, 2500))) for _ in range(n)]


def tagger(seed, lead):
    t = pii.Tagger(seed=seed)
    t.p["ob"][0] += lead  # how much of a text is open
    return t


def test_every_plausible_span_holds_a_seed():
    r = random.Random(4)
    for t in texts(r, 150):
        own = pii.base_spans(t)
        seeds = pii.seeds_of(t, own)
        for _ in range(200 if t else 0):
            s = r.randrange(len(t))
            e = min(len(t), s + r.choice([5, 20, 60, 400]))
            if any(pii.plausible(k, t[s:e]) for k in range(4)) and not any(s < y and x < e for _, x, y in own):
                assert ((seeds >= s) & (seeds < e)).any(), t[s:e]


def test_windows_around_seeds_give_what_whole_texts_give(monkeypatch):
    r, read = random.Random(8), []
    some = texts(r, 60)
    seeds = [pii.seeds_of(t, pii.base_spans(t)) for t in some]
    emit = pii.Reader.emit
    monkeypatch.setattr(pii.Reader, "emit", lambda self, ids: read.append(ids.shape[1]) or emit(self, ids))
    for seed, lead in ((3, 0.8), (5, 0.4), (6, 1.2), (7, 2)):
        read.clear()
        whole = pii.tag_texts(tagger(seed, lead), some)
        all_read = sum(read)
        read.clear()
        got = pii.tag_texts(tagger(seed, lead), some, 64, seeds)
        assert sum(read) <= all_read
        for t, w, g, at in zip(some, whole, got, seeds, strict=True):
            held = lambda x: any(x[1] <= p < x[2] for p in at)  # noqa: E731, B023
            assert [x[:3] for x in g if held(x)] == [x[:3] for x in w if held(x)]
            assert np.allclose([x[3] for x in g if held(x)], [x[3] for x in w if held(x)], atol=1e-4)
    assert sum(read) < all_read  # with a lead of 2 little is open


def test_texts_without_marks_are_not_read(monkeypatch):
    monkeypatch.setattr(pii.Reader, "emit", None)
    none = ["plain words, " * 50, "one 12 and 345, two 7"]
    assert pii.tag_texts(pii.Tagger(), none, seeds=[pii.seeds_of(t, []) for t in none]) == [[], []]
