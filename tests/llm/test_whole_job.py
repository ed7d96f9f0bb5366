import numpy as np
from sigloom.llm import decontam


def brute_best(item, words):
    """The best (edits, start, words) of all passages, by plain dynamic programming."""
    best = None
    for start in range(len(words)):
        row = list(range(len(words) - start + 1))
        for i, x in enumerate(item, 1):
            last, row[0] = row[0], i
            for j in range(1, len(row)):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (words[start + j - 1] != x))
        edits = min(row)
        if row.index(edits) and (best is None or edits < best[0]):
            best = (edits, start, row.index(edits))
    return best


def test_every_passage_within_the_edit_bound_is_found():
    rng = np.random.default_rng(8)
    texts, sure = [], []
    items = [(k, [f"v{x}" for x in rng.integers(0, 800, size)]) for k, size in enumerate([4, 7, 12, 15, 20, 33, 50, 57, 80])]
    for k, item in items:
        for share in (0.05, 0.1, 0.2):
            for _ in range(6):
                own = list(item)
                for _ in range(int(share * len(item))):
                    at = int(rng.integers(0, len(own)))
                    own[at : at + int(rng.integers(0, 2))] = [[], [f"x{rng.integers(0, 99)}"], [item[rng.integers(0, len(item))]]][rng.integers(0, 3)]
                lead, tail = ([f"y{x}" for x in rng.integers(0, 50, rng.integers(0, 6))] for _ in range(2))
                texts.append(lead + own + tail)
                sure.append((len(texts) - 1, k))
    found = {(t, k): (edits, start, words) for t, k, start, words, edits in decontam.found_in(decontam.Items([(k, " ".join(x)) for k, x in items]), [" ".join(t).encode() for t in texts])}
    assert set(sure) <= set(found)
    for t, k in sure[::3]:
        assert found[t, k] == brute_best(items[k][1], texts[t])
