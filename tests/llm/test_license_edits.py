"""License scans of edited templates: every one-word edit of the short ones, insertions of any length into long ones."""

import random

import numpy as np
import pytest

from tickloom.llm import licenses as li

INDEX = li.Index(li.TEMPLATES)
LONG = [t for t, ids in enumerate(INDEX.words) if len(ids) > 30]


def words_of(t):
    return li._WORD.findall(li.TEMPLATES[t][1].encode().lower())


def brute_matches(template, text):
    """The longest common subsequence, in words."""
    before = [0] * (len(text) + 1)
    for w in template:
        now = [0]
        for j, x in enumerate(text):
            now.append(before[j] + 1 if w == x else max(now[-1], before[j + 1]))
        before = now
    return before[-1]


def test_every_one_word_edit_of_short_templates():
    seen = 0
    for t, ids in enumerate(INDEX.words):
        words = words_of(t)
        if len(words) > 20:
            continue
        for at in range(len(words)):
            for edited in (words[:at] + words[at + 1 :], words[:at] + [b"zzz"] + words[at + 1 :], words[:at] + [b"zzz"] + words[at:]):
                matched = brute_matches(words, edited)
                if matched < 0.8 * len(words):
                    continue
                seen += 1
                text = b"and so on qqq " + b" ".join(edited) + b" vvv and so on"
                found = li.scan(text, INDEX)
                assert found, (words, edited)
                # another template may fit still better
                assert any(x[0] == INDEX.names[t] or x[1] * len(INDEX.words[x[3]]) >= matched for x in found), (words, edited, found)
    assert seen > 300


@pytest.mark.parametrize("inserted", [1, 11, 14, 40, 90])
@pytest.mark.parametrize("places", [1, 2, 3])
def test_insertions_into_long_templates(inserted, places):
    rng = random.Random(inserted * 10 + places)
    for t in LONG:
        words = words_of(t)
        for _ in range(4):
            edited = list(words)
            # each insertion stands alone: what may part a chain's alignments has a bound
            for at in sorted(rng.sample(range(8, len(words) - 7, 8), min(places, (len(words) - 15) // 8)), reverse=True):
                edited[at:at] = [b"x%d" % rng.randrange(1000) for _ in range(inserted)]
            found = li.scan(b" ".join([b"before"] * 30 + edited + [b"after"] * 30), INDEX)
            mine = [x for x in found if x[0] == INDEX.names[t]]
            assert mine and max(x[1] for x in mine) >= 0.8, (INDEX.names[t], inserted, places, found)


def test_lost_words_and_far_halves():
    words = words_of(LONG[0])
    cut = len(words) // 2
    near = li.scan(b" ".join(words[:cut] + words[cut + 8 :]), INDEX)
    assert near and near[0][1] >= 0.8
    assert not li.scan(b" ".join(words[:cut] + [b"other"] * 5000 + words[cut:]), INDEX)
    twice = li.scan(b" ".join(words + words), INDEX)
    assert [x[1] for x in twice if x[0] == INDEX.names[LONG[0]]] == [1.0, 1.0]


def test_sure_runs():
    """A text that matches so much of a template shares so long a run, wherever the lost words stand."""
    rng = np.random.default_rng(3)
    for n in range(4, 60):
        lost = n - int(np.ceil(0.8 * n - 1e-9))
        for _ in range(200):
            kept = np.ones(n, dtype=bool)
            kept[rng.choice(n, lost, replace=False)] = False
            runs = "".join("1" if k else " " for k in kept).split()
            assert max(map(len, runs)) >= li.sure_run(n)
