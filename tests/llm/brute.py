"""Plain versions of the corpus operators, one document after another."""

import hashlib
import re
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\f\r"
KINDS = ("email", "ip", "card", "phone")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def secrets(text):
    found = []
    pattern = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for m in re.finditer(pattern, text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    return sorted(found)


def spans(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def bytes_removed(rows, length=50):
    """rows (doc_id, text) -> {row number: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    datas = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in datas:
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            least[s] = min(least.get(s, d), d)
    out = {}
    for n, (d, b) in enumerate(datas):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < d:
                gone[i:i + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[n] = (len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def lines(rows, shortest=10):
    keyed, holders = [], defaultdict(set)
    lower = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
    for d, t in rows:
        parts = [(x, x.strip(SPACES).translate(lower)) for x in (t or "").split("\n")]
        keyed.append((d, parts))
        for _, k in parts:
            if len(k) >= shortest:
                holders[k].add(d)
    out = []
    for d, parts in keyed:
        kept = [x for x, k in parts if len(k) < shortest or min(holders[k]) == d]
        out.append((d, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return out


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(repeated)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n


def contamination(text, items, window=13):
    lower = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    patterns = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            patterns[tuple(w[a:a + window])].add(i)
    words, hit, found = cut(text), set(), set()
    for size in {len(p) for p in patterns}:
        for a in range(len(words) - size + 1):
            p = tuple(words[a:a + size])
            if p in patterns:
                hit |= set(range(a, a + size))
                found |= patterns[p]
    named = sorted("" if i is None else str(i) for i in found)
    return len(words), len(hit), len(named), sha(",".join(named)), len(hit) > 0 and 20 * len(hit) >= len(words)


def distance(a, b):
    """Word edit distance, whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def word_lists(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def near_pairs(rows, similarity=0.8, k=5):
    """Pairs of rows with that word edit similarity -> whether they also share so much of their k-word shingles."""
    words = [word_lists(t) for _, t in rows]
    bags = [Counter(w) for w in words]
    shingles = [{tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for w in words]
    out = {}
    for b in range(len(rows)):
        for a in range(b):
            longest = max(len(words[a]), len(words[b]))
            most = int((1 - similarity) * longest + 1e-9)
            if longest - sum((bags[a] & bags[b]).values()) <= most and (
                    words[a] == words[b] or distance(words[a], words[b]) <= most):
                out[a, b] = len(shingles[a] & shingles[b]) >= similarity * len(shingles[a] | shingles[b])
    return out


def classes(rows, pairs):
    """Smallest id of each row's connected component; rows sharing an id are one document."""
    least = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            x, y = rows[a][0], rows[b][0]
            m = min(least[x], least[y])
            changed |= least[x] != m or least[y] != m
            least[x] = least[y] = m
    return least


def sentences_removed(rows, bounds, least_words=25):
    """rows (doc_id, text), bounds: text -> word numbers at which pieces start -> per row (n_sentences, n_removed, n_spans, kept text)."""
    cut, first = [], {}
    for d, t in rows:
        t = t or ""
        ends = [m.end() for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", t)]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)]
        at = bounds(t) + [len(words)]
        places = []
        for w in at[:-1]:
            low = words[w - 1][1] if w else 0
            stops = [i + 1 for i in range(low, words[w][0]) if t[i] in ".!?\n"]
            places.append(stops[-1] if stops else 0 if not w else words[w][0])
        places.append(len(t))
        closing = {b for b in range(1, len(at)) if b == len(at) - 1 or any(c in ".!?\n" for c in t[words[at[b] - 1][1]:words[at[b]][0]])}
        runs = set()
        for a in range(len(at) - 1):
            runs.update([(a, b) for b in range(a + 1, len(at)) if at[b] - at[a] >= least_words][:1])
        for b in closing:
            runs.update([(a, b) for a in range(b - 1, -1, -1) if at[b] - at[a] >= least_words][:1])
        named = [(a, b, tuple(w[2] for w in words[at[a]:at[b]])) for a, b in sorted(runs)]
        for n, (_, _, key) in enumerate(named):
            first[key] = min(first.get(key, (d, n)), (d, n))
        cut.append((d, t, ends, words, at, places, named))
    out = []
    for d, t, ends, words, at, places, named in cut:
        dead = {p for n, (a, b, key) in enumerate(named) if first[key] < (d, n) for p in range(a, b)}
        lost = {sum(e <= words[w][0] for e in ends) for p in dead for w in range(at[p], at[p + 1])}
        kept = t[:places[0]] if len(at) > 1 else t
        kept += "".join(t[places[p]:places[p + 1]] for p in range(len(at) - 1) if p not in dead)
        out.append((len(ends), len(lost), sum(p - 1 not in dead for p in dead), kept))
    return out
