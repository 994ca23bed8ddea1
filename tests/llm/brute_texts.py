"""Plain Python versions of the contracts, for small inputs."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(texts, percent):
    """doc_id -> smallest id reachable over pairs with a Jaccard of percent / 100 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    of = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if all_ and 100 * both >= percent * all_ and of[a] != of[b]:
                    of[a] = of[b] = min(of[a], of[b])
                    changed = True
    return of
