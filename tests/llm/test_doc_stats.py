import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tarnbeck.llm.doc_stats import text_stats


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_match_brute_force():
    r = random.Random(5)
    texts = ["", None, "\n", "a", "a\na", "a\na\n", "\n\na\n", " \na \na", "é| é|\n\n", "x" * 5000, "a b c a b c", "a a a a"]
    texts += ["".join(r.choice(["a", "b", " ", "\n", "é", "\t", "#", "\x0b", "日"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    for size in (1, 7, len(texts)):
        for at in range(0, len(texts), size):
            part = texts[at : at + size]
            counts, f = text_stats(pa.array(part, pa.string()))
            assert list(zip(*(counts[c].tolist() for c in counts))) == [brute(t) for t in part]
            assert np.isfinite(f).all()
