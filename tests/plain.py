"""Plain single-text versions of the rules, written only to check the Spark expressions against."""

import re

SPACE = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
ABBR = ["e.g", "i.e", "etc", "vs", "cf", "approx", "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "No", "Fig", "Inc",
        "Ltd", "Co", "Jr", "Sr", "U.S", "U.K", "a.m", "p.m"] + [chr(c) for c in range(65, 91)]
OPEN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\"'“‘([¿¡•—-")


def clean(text):
    return " ".join(w for w in "".join(" " if ch in SPACE else ch for ch in text).split(" ") if w)


def after_abbreviation(head):
    return any(
        head.endswith(a) and (len(head) == len(a) or head[-len(a) - 1] == "(" or head[-len(a) - 1] in SPACE)
        for a in ABBR
    )


def sentence_ends(text):
    ends, i, n = [], 0, len(text)
    while i < n:
        if text[i] not in ".!?…":
            i += 1
            continue
        j = i
        while j < n and text[j] in ".!?…":
            j += 1
        k = j
        while k < n and text[k] in "\"'”’)]":
            k += 1
        m = k
        while m < n and text[m] in SPACE:
            m += 1
        if m > k and m < n and text[m] in OPEN:
            if not after_abbreviation(text[:i]):
                ends.append(m)
            i = m
        else:
            i = j
    return ends + [n]


def trimmed(text, s, e):
    body = [i for i in range(s, e) if text[i] not in SPACE]
    return (body[0], body[-1] + 1) if body else None


def sentence_spans(text):
    spans, s = [], 0
    for e in sentence_ends(text):
        while e - s > 480:
            spaces = [i for i in range(s + 241, s + 481) if text[i] == " "]
            cut = spaces[-1] if spaces else s + 480
            spans.append(trimmed(text, s, cut))
            s = cut
        spans.append(trimmed(text, s, e))
        s = e
    return [x for x in spans if x]


def long_pieces(text, limit=960):
    if len(text) <= limit:
        return [clean(text)] if clean(text) else []
    out = []
    for line in text.splitlines():
        words = clean(line)
        while len(words) > limit:
            at = max((i for i in range(limit // 2 + 1, limit) if words[i] == " "), default=limit)
            out.append(words[:at].strip(" "))
            words = words[at:].strip(" ")
        if words:
            out.append(words)
    return out or [""]


def packed_passages(text):
    """(s, e, text) of the passages of one web block."""
    if len(clean(text)) < 40:
        return []
    groups, room = [], -1
    for s, e in sentence_spans(text):
        if room < e - s:
            groups.append([s, e])
            room = 960
        groups[-1][1] = e
        room -= e - s
        if room < 0:
            room = 0
    return [(s, e, clean(text[s:e])) for s, e in groups if len(clean(text[s:e])) >= 40]


WEIGHT = {"direct_answer": 1.0, "qualification": 0.96, "counterpoint": 0.96}


def score(p, role, role_p):
    return (p or 0.0) * WEIGHT.get(role, 0.9) * (0.8 + 0.2 * (role_p or 0.0))


def reading_path(rows, threshold):
    """rows: (idx, p, role, role_p). Returns [(ord, idx, is_catch)]."""
    pool = [r for r in rows if r[1] is not None and r[1] >= threshold and r[2] not in (None, "irrelevant")]
    pool.sort(key=lambda r: (-score(*r[1:]), r[0]))
    picked = {}
    for r in pool:
        picked.setdefault(r[2], r[0])
    picked = set(picked.values())
    for r in pool:
        if len(picked) >= 3 and r[1] < max(0.62, threshold):
            break
        if len(picked) < 7:
            picked.add(r[0])
    catches = [r[0] for r in pool if r[0] in picked and r[2] in ("qualification", "counterpoint")]
    return [(n, i, bool(catches) and i == catches[0]) for n, i in enumerate(sorted(picked), 1)]
