"""The contamination rule by brute force."""

import re


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def contaminated(text, items):
    w = words(text)
    hit = [False] * len(w)
    for item in items:
        i = words(item or "")
        n = min(13, len(i))
        for a in range(len(i) - n + 1 if n else 0):
            window = i[a : a + n]
            for b in range(len(w) - n + 1):
                if w[b] == window[0] and w[b : b + n] == window:
                    hit[b : b + n] = [True] * n
    return any(hit) and 20 * sum(hit) >= len(w)
