"""Line dedup on long lines and short repeats."""

import random

from helpers import small
from test_lines import changed, classes, edits

from barloom.llm import line_dedup as ld


def sentence(rng, words=28):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 12))) for _ in range(words))


def replaced(rng, line, n):
    words = line.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = sentence(rng, 1)
    return " ".join(words)


def test_thresholds():
    assert [ld.allowed(n, True) for n in (8, 39, 40, 59, 60, 160, 5000)] == [1, 1, 2, 2, 3, 8, 8]
    assert [ld.allowed(n, False) for n in (1, 9, 10, 19, 20, 5000)] == [0, 0, 1, 1, 2, 2]


def test_keys_of_a_line_are_bounded():
    assert max(len(ld._pattern(n, True)[0]) for n in (*range(8, 400), 20_000)) < 250
    assert max(len(ld._pattern(n, False)[0]) for n in (*range(10, 400), 20_000)) < 25


def test_early_stop_of_banded_distance():
    rng = random.Random(9)
    for _ in range(300):
        a = sentence(rng, 4)
        b = changed(rng, a, rng.randint(0, 12), "abcdefg") if rng.random() < .7 else sentence(rng, 4)
        assert ld.within(a, b, 6) == min(edits(a, b), 7)
        assert ld.within(a.split(), b.split(), 2) == min(edits(a.split(), b.split()), 3)


def test_two_very_long_lines():
    rng = random.Random(10)
    a = sentence(rng, 60_000)
    assert ld.near(a, replaced(rng, a, 8)) and not ld.near(a, replaced(rng, a, 9))
    assert ld.near("x" * 400_000, "x" * 399_999 + "y") and not ld.near("x" * 400_000, "x" * 400_003)


def test_replaced_words_and_short_repeats(spark):
    rng = random.Random(7)
    base = [sentence(rng) for _ in range(30)]
    near = [replaced(rng, s, 1) for s in base]
    far = replaced(rng, base[0], 14)
    texts = [f"Menu\n{s}" for s in base] + [f"{s}\n\nMenu\nown line {k}" for k, s in enumerate(near)] + [f"{far}\nown line 0"]
    got = {r.doc_id: r.drops for r in ld.line_dedup(small(spark, texts)).collect()}
    # "own line 1" differs from "own line 0" by one character of ten, as do the others
    assert got == {0: ""} | {k: "0=0:0" for k in range(1, 30)} | {30 + k: f"0={k}:1,2=0:0" + (",3=30:3" if k else "") for k in range(30)} | {60: "1=30:3"}


def test_links_of_a_key_grow_with_its_lines():
    """Copies that are all near each other give a link less than there are lines, at once and block by block."""
    rng = random.Random(21)
    base = sentence(rng, 45)
    lines = list(dict.fromkeys(replaced(rng, base, rng.randint(0, 2)) for _ in range(120)))
    tag = [int(ld.keys_of([s])[3][0]) for s in lines]
    rows = [(k, True, t, k % 2, s) for k, (t, s) in enumerate(zip(tag, lines))]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if ld.near(lines[i], lines[j])]
    assert len(near) > 5 * len(lines)
    once = ld.links_of(rows, False)
    two = ld.links_of(rows[::2], False) + ld.links_of(rows[1::2], False) + ld.links_of(rows, True)
    for links, most in ((once, len(lines) - 1), (two, 2 * len(lines))):
        assert len(links) <= most and classes(len(lines), links) == classes(len(lines), near)
        assert all(ld.near(lines[u], lines[v]) for u, v in links)
