"""Plain Python counterparts of operators, and inputs for them."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\f\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def texts(seed, n=120):
    """(id, text): prose, copies, near copies, shared passages, junk and edge cases."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß日") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    prose = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, line = prose(60), prose(12)
    out = [prose(rnd.randint(1, 300)) for _ in range(n)]
    for i in range(0, n, 6):
        parts = out[rnd.randrange(n)].split(" ")
        for _ in range(rnd.randint(0, 4)):
            parts[rnd.randrange(len(parts))] = rnd.choice(vocabulary)
        out.append(" ".join(parts))
        out.append(out[i])
    for i in range(0, n, 9):
        at = rnd.randint(0, len(out[i]))
        out[i] = f"{out[i][:at]} {passage} {out[i][at:]}\n{line}\n{line}"
    out += [None, "", " \n\t ", "a", "a a a a a a a", "x" * 900, "x" * 900 + "y", "ab " * 500, "ba " * 400, passage, "é" * 350]
    return list(enumerate(out))


def frame(spark, rows, more=True):
    """A documents table; `more` adds columns with names that operators use inside."""
    if not more:
        return spark.createDataFrame(rows, "doc_id long, text string")
    names = "doc_id long, text string, k_id string, anchor int, place string, label string, n_words int, kept string"
    return spark.createDataFrame([(*r, "k", 1, None, "l", 7, "no") for r in rows], names)


def repeated_units(units, width):
    """For each list of units, which of them lie under a window that stands twice."""
    seen = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def shingle_set(text, k):
    w = words_of(ascii_lower(text))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k, percent):
    """Least id of each row's component; ids are distinct."""
    by_set = defaultdict(list)
    for i, text in rows:
        by_set[shingle_set(text, k)].append(i)
    sets = [s for s in by_set if s]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for a, s in enumerate(sets):
        members[root(a)] += by_set[s]
    out = {i: min(m) for m in members.values() for i in m}
    return out | {i: i for i in by_set.get(frozenset(), [])}


def measures(text):
    text = text or ""
    w = words_of(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def sha256(data):
    return hashlib.sha256(data).hexdigest()
