"""Runs of words that hold a licence against a search of all runs, and on texts of repeated notices."""

import random
import re
import time

from mensura.llm import licenses


def plain_windows(text, templates, threshold):
    """Of every first word the run of greatest Dice (the shortest of equal ones), the best runs first, none
    that shares a word with a unit that has the licence or with a better run."""
    words = re.findall("[a-z0-9]+", text)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    out = []
    for name, (template, length) in templates.items():
        most = int((2 - threshold) / threshold * length + 1e-9)
        found = []
        for first in range(len(grams)):
            runs = []
            for last in range(first, min(len(grams), first + most)):
                own = set(grams[first : last + 1])
                runs.append((-2 * len(own & template) / (len(own) + len(template)), last + 2))
            best = min(runs)
            if -best[0] >= threshold and grams[first] in template:
                found.append((best[0], first, best[1]))
        taken = licenses._taken(text, grams, template, threshold)
        for dice, first, end in sorted(found):
            if all(end <= a or first >= b for a, b in taken):
                taken.append((first, end))
                out.append((first, name, -dice))
    return out


def known(templates):
    return {n: (set(licenses.bigrams(t)), max(0, len(re.findall("[a-z0-9]+", t.lower())) - 1)) for n, t in templates.items()}


def test_windows_equal_a_search_of_all_runs():
    rng = random.Random(1)
    short = {"a": "released under the small licence of one line only", "b": "provided as is without any kind of warranty at all to you", "c": "one two one two one two three"}
    templates, hits = known(short), 0
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(list(short.values())).split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice(["x", "the", "one"])
            parts.append(" ".join(t if rng.random() < 0.7 else [rng.choice(["foo", "bar", "the", "one", "two"]) for _ in range(rng.randrange(12))]))
        text = "".join(p + rng.choice([" ", " ", ". ", "\n", "\n\n"]) for p in parts)
        got = licenses.windows(text, templates, 0.8)
        assert got == plain_windows(text, templates, 0.8)
        hits += len(got)
    assert hits > 300


def test_repeated_notices_take_bounded_time():
    templates = known(licenses.TEMPLATES)
    name, notice = next((n, t) for n, t in licenses.TEMPLATES.items() if 15 <= len(t.split()) <= 60)
    text = " ".join(f"file{k} {notice.lower()}".replace("\n", " ") for k in range(3000))
    began = time.time()
    got = [w for w in licenses.windows(text, templates, 0.8) if w[1] == name]
    assert len(got) == 3000 and time.time() - began < 60
