"""Plain versions of what the operators compute, for small tables; texts by doc_id, no null among them."""

import re
from collections import Counter

from linkledger.llm import toxicity


def brute_clauses(text, stems):
    """What the grammar matches, clause by clause, without transducers."""
    is_insult = lambda w: next((stems[k] for k in [w + "$", *[w[:n] for n in range(len(w), 2, -1)]] if k in stems), 0)
    fixed = {w: k for k, ws in (("target", toxicity.PERSONS + toxicity.DETERMINERS + toxicity.COPULAS), ("threat", toxicity.THREATS), ("not", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) for w in ws}
    for clause in re.split(r"[.!?;\n]", text.lower()):
        kinds = [("insult", w) if (w := is_insult(x)) else (fixed.get(x), 1) for x in re.findall(r"\w+", clause)]
        names = [k for k, _ in kinds]
        insults = [w for k, w in kinds if k == "insult"]
        hot = [i for i, k in enumerate(names) if k in ("insult", "threat")]
        # A threat waits for a target among the next three words; a new threat starts the wait again.
        menace = any(k == "threat" and "target" in names[i + 1 : i + 4] for i, k in enumerate(names))
        if not (menace or insults and "target" in names):
            continue
        total = sum(w if i == 0 else w / 2 for i, w in enumerate(insults)) + names.count("threat")
        negated = [any("not" == names[j] for j in range(max(0, i - 3), i)) for i in hot]
        factor = 1.25 if menace and insults else 1
        kind = toxicity.MENACE if menace else toxicity.AIMED
        if all(negated):
            kind, factor = toxicity.NEGATED, factor / 2
        elif "report" in names:
            kind, factor = toxicity.REPORTED, factor / 2
        yield kind, total * factor


def brute_kept_lines(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = {}
    for d, x in rows.items():
        for line in x.split("\n"):
            held.setdefault(key(line), set()).add(d)
    gone = {k: max(ds) for k, ds in held.items() if len(k) >= 20 and len(ds) >= 3}
    return {d: "\n".join(y for y in x.split("\n") if gone.get(key(y), d) == d) for d, x in rows.items()}


def shingles_of(text, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute_components(nodes, pairs):
    """The smallest node that each one reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_repeats(rows, length=200):
    """(bytes that stay, removed bytes, maximal removed runs) by doc_id."""
    count = Counter(b[i : i + length] for b in rows.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in rows.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out[d] = bytes(x for x, g in zip(b, gone) if not g), sum(gone), len(re.findall(rb"\x01+", bytes(gone)))
    return out
